"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a long run of key characters that starts shortly after a sensitive word, or holds one. Every such word cuts
the run, and each piece is scored; pieces do not overlap, so time is linear in the text. Its novelty is the number of bytes
that it adds to a zstandard frame whose dictionary holds common identifiers and the text around it without further copies
of the candidate, divided by its length: words and paths cost little, random keys cost most of their length, repeated or
not. A piece that is not novel as a whole is scored part by part, between separators. What fixed patterns match inside a
novel piece keeps its own span, and the rest of the piece is reported beside it, so all of a key is.

A null text is empty. An empty text has no spans, an empty table no rows. Very long texts are scanned whole. Spans are
code points, end exclusive, in order of start and then kind; equal starts keep that order. Columns of any name pass
through ``redact`` unchanged and are ignored by ``scan``; repeated rows are treated alike.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

# Words that make the text after them sensitive, and identifiers that are common in code.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "auth", "bearer", "credential", "private key", "access key", "signature")
SENSITIVE_AT = re.compile("|".join(re.escape(w) for w in SENSITIVE), re.ASCII | re.IGNORECASE)
SHORTEST = 16
PART = re.compile(r"[A-Za-z0-9]{%d,}" % SHORTEST)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
IDENTIFIERS = b"authorization bearer certificate client configuration connection credential database description development environment example function identifier implementation information initialize localhost organization parameter placeholder production property public private reference repository request response return service session signature string template timestamp undefined username variable version https http www com org json yaml import class static const default null true false abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 -------- ________"
REACH, AROUND, NOVELTY = 48, 512, 0.6


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of the candidate for each of its own."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    base = around[-64:].encode()
    return (len(pack.compress(base + candidate.encode())) - len(pack.compress(base))) / len(candidate)


def surroundings(text: str, start: int, end: int) -> str:
    """The text around a candidate, every other copy of it blanked, those that the window's edges would cut included."""
    body, wide = text[start:end], AROUND + end - start
    return text[max(0, start - wide) : start].replace(body, " ")[-AROUND:] + text[end : end + wide].replace(body, " ")[:AROUND]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def outside(start: int, end: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans, in order of start, leave of a stretch."""
    out = []
    for a, _, b in known:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    return [(x, y) for x, y in [*out, (start, end)] if x < y]


def novel_spans(text: str, low: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sensitive words cut runs into pieces, which do not overlap. Of a novel piece all is reported that base spans do not cover; of another one, its novel parts between separators."""
    if not any(w in low for w in SENSITIVE):
        return []
    out, ends = [], [m.end() for m in SENSITIVE_AT.finditer(text)]
    starts, longest = [a for a, _, _ in known], max((b - a for a, _, b in known), default=0)

    def novel(start: int, end: int) -> bool:
        body = text[start:end]
        return end - start >= SHORTEST and any(c.isdigit() for c in body) and any(c.isalpha() for c in body) and novelty(body, surroundings(text, start, end)) >= NOVELTY

    for run in CANDIDATE.finditer(text):
        first, last = bisect.bisect_left(ends, run.start() - REACH), bisect.bisect_left(ends, run.end())
        if first == last:
            continue
        cut = [max(run.start(), ends[first]), *(e for e in ends[first + 1 : last] if e > run.start()), run.end()]
        for start, end in zip(cut, cut[1:]):
            near = [x for x in known[bisect.bisect_left(starts, start - longest) : bisect.bisect_left(starts, end)] if x[2] > start]
            rest = outside(start, end, near)
            if not rest:
                continue
            if novel(start, end):
                out += [(x, 3, y) for x, y in rest]
            else:
                out += [(m.start(), 3, m.end()) for x, y in rest for m in PART.finditer(text, x, y) if novel(m.start(), m.end())]
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base patterns; of all."""
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + novel_spans(text, low, base))


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each whole text, one row for each document."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def each(batch):
            out = [spans(t or "") for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0)} | {f"n_{KINDS[k]}": [sum(x[1] == k for x in b) for b, _ in out] for k in range(3)} | {
                "base_sha256": [hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in out],
                "spans": [shown(a) for _, a in out],
                "n_novel": [sum(x[1] == 3 for x in a) for _, a in out],
            }

        return each

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long", make)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, _, b in spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by a mark; all other columns as they were, and a null text stays null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def make():
        def each(batch):
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            yield cols | {text_col: [None if t is None else redacted(t) for t in cols[text_col].to_pylist()]}

        return each

    return arrow_map(docs, schema, make)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
