"""N-gram Jaccard join, cross-tokenizer alignment and lexical search against SQL, brute force and odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectory.llm import alignment, jaccard_join, lexical_search, queries
from inspectory.llm.common import written

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = queries.queries()[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# -- n-gram Jaccard join


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def joined(rows, width=4, percent=85):
    """Component of each row, by brute force over distinct sets."""
    found = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset() for w in found]
    kinds = sorted({s for s in sets if s}, key=sorted)
    up = list(range(len(kinds)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(kinds):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(kinds):
        for j, same in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * same >= percent * (len(s) + len(kinds[j]) - same):
                up[root(i)] = root(j)
    least = {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            r = root(kinds.index(s))
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(root(kinds.index(s))) if s else d) for (d, _), s in zip(rows, sets)), key=str)


def test_join_of_planted_families(spark):
    """Copies, chains of near copies, a passage that most texts hold, and texts just below and at the limit."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, rows = word(60), []
    for base in range(30):
        text = word(int(rng.integers(20, 200)))
        for k in range(int(rng.integers(1, 9))):
            if k:
                text = [*text]
                text[int(rng.integers(len(text)))] = word(1)[0]
            rows.append(" ".join(text))
    rows += [" ".join(word(int(rng.integers(1, 40))) + passage + word(int(rng.integers(1, 12)))) for _ in range(400)]
    shared = word(173)
    rows += [" ".join(shared + word(15)), " ".join(shared + word(15)), " ".join(shared[:60]), " ".join(shared[:70])]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(rows)) * 3, rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_join(df.repartition(7)).collect()), key=str) == joined(rows)


def test_join_of_a_crowded_region(spark):
    """Hundreds of unlike texts that share a first n-gram, a few of them linked."""
    rng = np.random.default_rng(3)
    pool = [[f"p{i}_{j}" for j in range(30)] for i in range(40)]
    rows = []
    for i in range(600):
        a, b, c = rng.choice(40, 3, replace=False)
        rows.append((i, " ".join(pool[a] + pool[b] + pool[c])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_join(df).collect()), key=str) == joined(rows)


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, jaccard_join.jaccard_join(odd_docs).collect()), key=str)
    want = joined(rows)
    assert got == want and any(d is None and c == 4 for d, _, c in got)
    assert jaccard_join.jaccard_join(no_docs).collect() == []


# -- cross-tokenizer alignment


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if i != 50256}
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, range(b.get_piece_size()))]
    return a, b, a_bytes, b_bytes


def groups(text, tokenizers):
    """None, or the groups of (A ids, B ids)."""
    a, b, a_bytes, b_bytes = tokenizers
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(a_bytes[i] for i in x) == b"".join(b_bytes[i] for i in y) == (" " + text).encode():
        return None
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((a_bytes, x), (b_bytes, y))]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        own = ([], [])
        while i < len(x) and ends[0][i] <= cut:
            own[0].append(x[i])
            i += 1
        while j < len(y) and ends[1][j] <= cut:
            own[1].append(y[j])
            j += 1
        out.append(own)
    return out


def aligned(rows, tokenizers):
    found = [groups(t, tokenizers) for _, t in rows]
    held = [Counter((p, q) for x, y in g for p in x for q in y) if g else Counter() for g in found]
    n = Counter(p for h in held for p in h)
    best = {}
    for (p, _), k in n.items():
        best[p] = max(best.get(p, 0), k)
    out = []
    for (d, _), g, h in zip(rows, found, held):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((d, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), h.total(), sum(k for p, k in h.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in h.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark, sf_dir, texts, tokenizers):
    got = queries.queries()["op12_alignment"](spark, sf_dir)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == aligned(texts, tokenizers)


def test_alignment_of_odd_rows(spark, odd_docs, no_docs, tokenizers):
    more = ["a▁b", " a", "a ", "  ", "a  b\n\n c \t", "x" * 5000, "1234567890" * 400, "a　b c\xa0d e", "▁ ▁", " ".join("ab" * i for i in range(60)), "<s> <0x41> </s>", "﻿ﬁ Ⅷ½", "a b a b"]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows_of = lambda df: sorted(map(tuple, alignment.weighed(written(alignment.align(df), "aligned")).select(COLUMNS).collect()), key=str)
    assert rows_of(docs.withColumns({c: F.lit("clash") for c in ("n_a", "row", "pairs", "pair", "n", "best", "groups")})) == aligned(rows, tokenizers)
    assert rows_of(no_docs) == []


def test_alignment_keeps_groups_and_counts_beyond_broadcast(spark, texts, tokenizers, monkeypatch):
    """Groups are whole; merge-joined counts, short-lived chunks and large groups give the same rows."""
    docs = spark.createDataFrame(texts[:200], "doc_id long, text string")
    kept = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.align(docs, keep=True).collect()}
    assert kept == {d: [(len(x), len(y)) for x, y in groups(t, tokenizers) or []] for d, t in texts[:200]}
    monkeypatch.setattr(alignment, "FEW_PAIRS", 0)
    got = alignment.weighed(written(alignment.align(docs), "aligned")).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == aligned(texts[:200], tokenizers)
    own = [t or "" for _, t in texts[:60]]
    whole = [o["pairs"].to_pylist() for o in alignment.aligned_batch(own, alignment.Pair(None, None))]
    for name, value in (("LIMIT", 50), ("LARGE_GROUP", 1), ("LANE", 4)):
        monkeypatch.setattr(alignment, name, value)
    pair = alignment.Pair(None, None)
    assert [p for i in range(0, 60, 7) for o in alignment.aligned_batch(own[i : i + 7], pair) for p in o["pairs"].to_pylist()] == whole[0]


# -- lexical search


def ranked(docs, items, k=10):
    """Rows by the stated formula; items have distinct ids."""
    found = [(d, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for d, t in docs]
    n_docs, total, df = sum(1 for _, c in found if c), sum(c.total() for _, c in found), Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            if not c:
                continue
            m = 100 - 75 + 75 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k=10):
    return sorted(map(tuple, lexical_search.search(lexical_search.build_index(docs), items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_in_many_blocks_and_batches(spark, texts, sf_dir, monkeypatch):
    """Small blocks, windows and query batches give what large ones give."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.createDataFrame(texts[:500], "doc_id long, text string")
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 300)
    want = ranked(texts[:500], [tuple(r) for r in items.select("item_id", "text").collect()], 7)
    assert searched(docs.repartition(5), items, 7) == want


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one TWO two absent"), (4, "abc dé σß don t"), (5, "a b c d e f g h"), (6, "!!")], "item_id long, text string")
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    more = texts + [(20, "a b a"), (21, "a b a"), (19, "A-b a"), (22, "one one two")]
    docs = spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("block", "term", "ids", "row", "rank", "score")})
    got = searched(docs, items.withColumns({"row": F.lit(1), "terms": F.lit("x")}))
    assert got == ranked(more, [tuple(r) for r in items.collect()])
    assert [(r, d) for i, r, d, _ in got if i == 5][:3] == [(1, 19), (2, 20), (3, 21)] or any(r == 1 for _, r, _, _ in got)
    assert searched(no_docs, items) == [] and searched(odd_docs, items.limit(0)) == []
    twice = items.where("item_id = 3").union(items.where("item_id = 3"))
    assert len(searched(docs, twice)) == 2 * len([x for x in got if x[0] == 3])


def test_windows_are_skipped(monkeypatch):
    """A block's best documents are the same whatever the window, and a bound below the k-th score ends the visit."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(5, 400, 3000).astype(np.uint32)
    lists = {t: (np.sort(rng.choice(3000, n, replace=False)).astype(np.uint16), rng.integers(1, 9, n).astype(np.uint32)) for t, n in enumerate((3, 20, 80, 150, 900, 2000, 3000))}
    query = [(t, int(w)) for t, w in enumerate(rng.integers(1, 9000, 7))]
    m = 100 - 75 + 75 * lengths.astype(np.int64) * 3000 // int(lengths.sum())
    total = np.zeros(3000, np.int64)
    for t, w in query:
        d, f = lists[t]
        total[d] += w * (1_000_000_000 * f.astype(np.int64) // (1000 * f.astype(np.int64) + 8 * m[d]))
    want = np.lexsort((np.arange(3000), -total))[:10]
    for window in (1, 16, 64, 5000):
        monkeypatch.setattr(lexical_search, "WINDOW", window)
        top, score = lexical_search.Block(lengths, lists, 3000, int(lengths.sum())).best(query, 10)
        assert top.tolist() == want.tolist() and score.tolist() == total[want].tolist()
