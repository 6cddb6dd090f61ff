"""Each operator against brute force on a whole small table, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectory.llm import classifier, decontaminate, licenses, near_duplicates, packing, quality_rules, queries, secrets, sharding, suffix_dedup, token_output, tokens

BLANK = r"[^\x20\x09-\x0D]+"


def run(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).collect()


def by_id(docs):
    out = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        out[r.doc_id].append(r.text)
    return out


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# -- sharding


def test_sharding(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op1_sharding")
    want = {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(40))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in own) for own in by.values()]
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 40
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_shards_of_rows_without_ids(spark):
    """A fifth of the ids is null: sizes are near equal all the same, and a column ``place`` stays."""
    rows = spark.range(20_000).selectExpr("if(id % 5 = 0, null, id) as doc_id", "100 + id % 7 as size", "hash(id) as text_crc32", "'kept' as place")
    placed, _ = sharding.shard_by_slots(rows, 8, tie=("text_crc32", "size"))
    loads = [r.n for r in placed.where("place = 'kept'").groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.02 * sum(loads) / 8


def test_slot_map_versions(spark, tmp_path):
    loads = {s: 100 + s for s in range(64)}
    one = sharding.SlotMap.even(64, 4)
    two = one.rebalanced(loads)
    three = two.rebalanced(loads, 5)
    assert (one.version, two.version, three.version) == (0, 1, 2)
    assert set(three.owners) == set(range(5))
    assert two.rebalanced(loads).owners == two.owners or max(Counter(two.owners).values()) <= 20
    at = str(tmp_path / "map")
    assert sharding.SlotMap.load(spark, at) is None
    for m in (one, two, three):
        m.save(spark, at)
    assert sharding.SlotMap.load(spark, at).owners == three.owners and sharding.SlotMap.load(spark, at).shards == 5
    assert sharding.SlotMap.load(spark, at, 0).owners == one.owners
    with pytest.raises(Exception, match="exists"):
        three.save(spark, at)


def test_slot_map_is_edited_from_run_to_run(spark, tmp_path):
    at = str(tmp_path / "map")
    sized = lambda n: spark.range(n).selectExpr("id as doc_id", "100 + id % 7 as size")
    place = lambda n, shards: sharding.shard_by_slots(sized(n), shards, slots=64, map_path=at)
    maps, rows = [], []
    for n, shards in ((4000, 4), (4000, 4), (4400, 4), (4400, 5)):
        placed, m = place(n, shards)
        maps.append(m)
        rows.append({r.doc_id: (r.shard, r.virtual_slot) for r in placed.collect()})
        newest = sharding.SlotMap.load(spark, at)
        assert (newest.owners, newest.version) == (m.owners, m.version) and len(newest.owners) == 64
    for one, two, a, b in zip(maps, maps[1:], rows, rows[1:]):
        edited = {s for s in range(64) if one.owners[s] != two.owners[s]}
        assert two.version in (one.version, one.version + 1) and (two.version > one.version or not edited)
        assert {d for d in a if a[d][0] != b[d][0]} <= {d for d in a if a[d][1] in edited}
    assert set(maps[-1].owners) == set(range(5)) and maps[-1].version > maps[-2].version
    with pytest.raises(ValueError):
        sharding.shard_by_slots(sized(10), 4, slots=32, map_path=at)


def test_sharding_odd(spark, odd_docs, no_docs):
    sized = odd_docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    placed, _ = sharding.shard_by_slots(sized, 3)
    rows = placed.collect()
    assert len(rows) == odd_docs.count()
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    empty, m = sharding.shard_by_slots(no_docs.withColumn("size", F.lit(0).cast("long")), 3)
    assert empty.count() == 0 and len(m.owners) == sharding.SLOTS


# -- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op2_secrets")}
    for d, t in texts:
        want = brute_spans(t)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        r = got[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 20


def test_novelty():
    code = "def connect(host, user): return client(host=host, user=user)  # auth header: "
    key = "q8Zr4TnV1xKp7LwB3yHd9sJf"
    assert "novel" in secrets.shown(secrets.spans(code + key)[1])
    assert secrets.shown(secrets.spans(code + "connectionconfiguration1")[1]) == ""
    assert secrets.shown(secrets.spans("no context at all " + key)[1]) == ""
    assert secrets.spans("PASSWORD = 'abc' token:a token=abcdefgh ſecret=abcdefgh")[0] == brute_spans("PASSWORD = 'abc' token:a token=abcdefgh ſecret=abcdefgh")
    assert secrets.redacted("x password=abcdefgh y") == "x [REDACTED] y"


def test_repeated_and_far_keys():
    key = "q8Zr4TnV1xKp7LwB3yHd9sJf"
    novel = lambda t: [(a, b) for a, k, b in secrets.spans(t)[1] if k == 3]
    for between in (" and again: bearer ", " ." * 200 + " bearer ", " ." * 247 + " bearer "):  # the last copy is cut by the window's edge
        text = f"bearer {key}{between}{key} end"
        assert novel(text) == [(7, 31), (31 + len(between), 55 + len(between))]
        assert key not in secrets.redacted(text)
    for gap in (33, 40, 48):
        assert novel("bearer" + " " * gap + key) == [(6 + gap, 30 + gap)]
    assert novel("bearer" + " " * 49 + key) == []


def test_secrets_in_linear_time():
    import time

    key = "q8Zr4TnV1xKp7LwB3yHd9sJf"
    for text in ("token" * 200_000, "token " * 200_000, "token=abcdef " * 50_000, "a" * 1_000_000, "secret " + "ab1" * 300_000):
        began = time.time()
        secrets.spans(text)
        assert time.time() - began < 10
    novel = lambda t: [(a, b) for a, k, b in secrets.spans(t)[1] if k == 3]
    assert novel(f"token{key}") == [(5, 29)] and novel(f"tokentoken{key} {key}") == [(10, 34), (35, 59)]
    assert novel(f"auth_connection_password_{key}")[0][1] == 49


def brute_novel(text):
    """By the rule, character by character: a piece starts where a run does or a sensitive word ends, and base spans are taken out."""
    base = {i for x, _, y in brute_spans(text) for i in range(x, y)}
    ends = {m.end() for m in re.finditer("|".join(map(re.escape, secrets.SENSITIVE)), text, re.A | re.I)}

    def novel(a, b):
        body = text[a:b]
        return len(body) >= 16 and re.search("[0-9]", body) and re.search("[A-Za-z]", body) and secrets.novelty(body, secrets.surroundings(text, a, b)) >= secrets.NOVELTY

    def runs(chars):
        out = []
        for i in sorted(chars):
            if out and out[-1][1] == i:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
        return out

    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        starts = [e for e in ends if m.start() <= e < m.end()]
        if any(m.start() - secrets.REACH <= e < m.start() for e in ends):
            starts.append(m.start())
        cut = sorted({*starts, m.end()})
        for a, b in zip(cut, cut[1:]):
            rest = runs(set(range(a, b)) - base)
            if rest and novel(a, b):
                out += [(x, 3, y) for x, y in rest]
            else:
                for x, y in rest:
                    out += [(x + p.start(), 3, x + p.end()) for p in re.finditer("[A-Za-z0-9]+", text[x:y]) if novel(x + p.start(), x + p.end())]
    return sorted(out)


def test_no_part_of_a_key_is_left():
    """A key between sensitive words and paths of one run; a key whose middle is a base match."""
    rng = np.random.default_rng(8)
    chars = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    draw = lambda n, of=chars: "".join(rng.choice(of, n))
    words = "configuration production organization parameter placeholder environment repository".split()
    for _ in range(200):
        key = draw(22) + "7z"
        path = lambda: "-".join(rng.choice(words, 3))
        text = f"see secret-{path()}-token-{key}-production/{path()}-auth-organization-parameter-placeholder1 end"
        assert key not in secrets.redacted(text) and secrets.redacted(text).startswith("see secret-")
        left, hexes, right = draw(9) + "4", draw(24, list("0123456789abcdef")), "Z" + draw(29) + "5"
        left_over = secrets.redacted(f"bearer {left}{hexes}{right} end")
        assert left_over.replace("[REDACTED]", "") == "bearer  end"


def test_novel_spans_equal_the_rule(texts):
    rng = np.random.default_rng(6)
    keys = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), int(rng.integers(12, 50)))) for _ in range(60)]
    made = [f"{w}{' ' * int(rng.integers(0, 60))}{k} text {k} {w}={k}" for k, w in zip(keys, secrets.SENSITIVE * 5)]
    made += [f"{w}-{k}-auth/{v}_configuration-placeholder-token{v}0123456789abcdef0123456789{k}" for k, v, w in zip(keys, keys[1:], secrets.SENSITIVE * 5)]
    found = 0
    for t in [*made, *(t or "" for _, t in texts)]:
        want = brute_novel(t)
        found += len(want)
        assert [x for x in secrets.spans(t)[1] if x[1] == 3] == want
    assert found > 30


def test_secrets_odd(odd_docs, no_docs):
    assert sorted((r.doc_id or 0, r.spans) for r in secrets.scan(odd_docs).collect()) == sorted((r.doc_id or 0, "") for r in odd_docs.collect())
    assert secrets.scan(no_docs).count() == 0
    kept = secrets.redact(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))


# -- licences


def test_licenses(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, "op3_licenses")}
    for d, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())


def test_templates():
    auto = {k: [licenses.Automaton(m) for m in v] for k, v in licenses.TEMPLATES.items()}
    labels = lambda t: licenses.scan_text(t.encode(), auto)[5]
    assert labels("Copyright (c) 2020 Someone. All Rights Reserved.") == "all-rights-reserved"
    assert labels("released under the terms of the MIT License") == "mit"
    grant = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    assert labels(grant) == "isc"
    assert labels(grant.replace("hereby", "gladly")) == ""
    a = licenses.Automaton("by <<2>> end [[really]] now")
    assert [a.accepts(x.split(), 0) for x in (b"by end now", b"by a b end really now", b"by a b c end now")] == [True, True, False]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_templates_tell_licences_apart():
    auto = {k: [licenses.Automaton(m) for m in v] for k, v in licenses.TEMPLATES.items()}
    labels = lambda t: licenses.scan_text(t.encode(), auto)[5]
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert labels("Copyright 2020 A. Person\n\n" + MIT) == labels("The MIT License (MIT)\n" + MIT) == "mit"
    assert labels(MIT.replace("SHALL THE AUTHORS", "WILL THE AUTHORS")) == labels(MIT[:400]) == ""
    assert labels(BSD.format("")) == "bsd-2-clause"
    assert labels(BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")) == ""
    assert labels(gpl.format(3)) == labels("under the GNU General Public License v3") == "gpl-3"
    assert labels(gpl.format(2)) == labels("licensed under the GNU General Public License, version 2") == labels("under the GNU General Public License") == ""
    cc = "licensed under a Creative Commons Attribution{} 4.0 International License"
    assert [labels(cc.format(x)) for x in ("", "-NonCommercial", "-ShareAlike", "-NonCommercial-ShareAlike", "-NoDerivatives")] == ["cc-by", "cc-by-nc", "", "", ""]


def test_licenses_odd(odd_docs, no_docs):
    count = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or ""))
    want = sorted((r.doc_id or 0, count(r.text)) for r in odd_docs.collect())
    rows = licenses.scan(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == want
    assert {(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows} == {(0, None, None, "", "", 0.0)}
    assert licenses.scan(no_docs).count() == 0


# -- near duplicates


def brute_groups(texts, width, percent=80):
    sets = {}
    for d, t in texts:
        w = [x for x in re.findall(BLANK, lower(t or ""))]
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    both = Counter((a, b) for own in where.values() for i, a in enumerate(own) for b in own[i + 1 :])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(documents, texts, width):
    got = near_duplicates.near_duplicates(documents, width).collect()
    want = brute_groups(texts, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(not r.kept for r in got) > 50


def test_near_duplicates_odd(odd_docs, no_docs):
    rows = near_duplicates.near_duplicates(odd_docs, 4).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept
    assert by[5].component_id == by[None].component_id == 4 and by[7].n_shingles == 1 and not by[None].kept
    assert sum(r.stays for r in rows if r.component_id == 4) == 1 and sum(r.kept for r in rows if r.component_id == 4) == 2  # id 4 stands twice
    assert near_duplicates.near_duplicates(no_docs, 4).count() == 0


def test_near_duplicates_with_equal_and_null_ids(spark):
    """A name that unlike texts share links none of them; a group of null ids keeps one row."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    rows = [(3, a), (5, b), (5, b), (9, a + " more"), (9, c), (None, e), (None, e), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("row", "head", "carried", "component_id", "stays", "sig")})
    got = near_duplicates.near_duplicates(df, carry=("row", "sig")).collect()
    assert sorted((r.doc_id or 0, r.text, r.component_id or 0) for r in got) == sorted([(3, a, 3), (5, b, 5), (5, b, 5), (9, a + " more", 3), (9, c, 9), (0, e, 0), (0, e, 0), (0, c, 9)])
    assert sorted((r.doc_id or 0, r.text) for r in got if r.stays) == sorted([(3, a), (5, b), (9, c), (0, e)])
    assert all(r.row == r.sig == "clash" for r in got)


def test_near_duplicates_in_a_large_family(spark):
    """5,000 relatives at 0.786 of each other, linked with nobody but for 500 pairs at 0.802."""
    rng = np.random.default_rng(11)
    base = [f"c{i}" for i in range(88)]
    docs = [(d, " ".join([*base, f"p{d % 2500 if d % 2500 < 500 else d + 10_000}", *(f"u{d}x{i}" for i in range(11))])) for d in range(5000)]
    docs = [docs[i] for i in rng.permutation(len(docs))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (100, d % 2500 if d % 2500 < 500 else d) for d in range(5000)}


def test_neighbours_meet_over_partitions():
    far = near_duplicates.NEAR + 1
    key = np.array([[1, 1, 1, 1, i, 0] for i in range(far + 1)])
    tree, rep = np.zeros(far + 1), np.arange(far + 1)
    pairs = lambda gap: {(a, b): s for a, b, s in near_duplicates.neighbours(tree, key, rep, gap).tolist()}
    assert pairs(None)[0, 3] == 3 and (0, far) not in pairs(None)
    assert (2, 3) not in pairs(np.arange(far + 1) == 3)


def test_near_duplicates_in_a_family(spark, monkeypatch):
    """300 relatives at 0.786 of each other; 30 pairs of them, far apart by id, at 0.802."""
    base = [f"c{i}" for i in range(88)]
    docs = []
    for d in range(300):
        own = [f"u{d}x{i}" for i in range(11)]
        docs.append((d, " ".join([*base, f"p{d % 150 if d % 150 < 30 else d + 1000}", *own])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: (100, d % 150 if d % 150 < 30 else d) for d, _ in docs}
    assert brute_groups(docs, 1) == want
    for rows in (near_duplicates.BLOCK_ROWS, 16):
        monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df, 1).collect()} == want


# -- decontamination


def norm(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t or ""))


def brute_matches(docs, items):
    """{(row, item): (start, words, equal)} by every diagonal and, on each, every stretch."""
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in norm(t)], int)
    items = [(i, coded(t)) for i, t in items]
    out = {}
    for row, (_, t) in enumerate(docs):
        d = coded(t)
        for i, w in items:
            n = len(w)
            if not n or not len(d):
                continue
            equal = d[:, None] == w[None, :]
            p, q = np.nonzero(equal)
            shifts, count = np.unique(p - q, return_counts=True)
            for s in shifts[5 * count >= 4 * min(13, n)].tolist():
                on = [0 <= j + s < len(d) and bool(equal[j + s, j]) for j in range(n)]
                if 0 <= s <= len(d) - n and 5 * sum(on) >= 4 * n:
                    spans = [(0, n)]
                else:
                    spans = [(x, y) for x in range(n) if on[x] for y in range(x + min(13, n), n + 1) if on[y - 1] and 5 * sum(on[x:y]) >= 4 * (y - x)]
                for x, y in spans:
                    new = (y - x, -(x + s), sum(on[x:y]))
                    if (row, i) not in out or new > out[row, i]:
                        out[row, i] = new
    return {k: (-at, n, same) for k, (n, at, same) in out.items()}


def test_decontamination(spark, sf_dir, texts, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_matches(texts, [(r.item_id, r.text) for r in bench.collect()])
    want = {(texts[row][0], i, *v) for (row, i), v in want.items()}
    assert {tuple(r) for r in decontaminate.matches(documents, bench, few_seeds=0, few_bytes=0).collect()} == want
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.n_equal) for r in run(spark, sf_dir, "op5_decontamination")}
    assert got == want and len({d for d, *_ in want}) > 10


def test_decontamination_of_changed_copies(spark, sf_dir, texts):
    """Items in documents with 5 to 35 % of their words replaced."""
    rng = np.random.default_rng(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = []
    for n, (_, t) in enumerate(items * 4):
        w = t.split()
        for j in np.flatnonzero(rng.random(len(w)) < rng.uniform(0.05, 0.35)):
            w[j] = "zz"
        around = texts[n][1].split()
        docs.append((n, " ".join(around[: len(around) // 2] + w + around[len(around) // 2 :])))
    want = {(row, i, *v) for (row, i), v in brute_matches(docs, items).items()}
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want and sum(n > same for *_, n, same in want) > 50


def test_substitutions(spark):
    noise, other = [f"n{i}" for i in range(30)], [f"m{i}" for i in range(30)]
    item = [f"w{i}" for i in range(20)]
    changed = [w if i not in (3, 8, 14) else "other" for i, w in enumerate(item)]
    beyond = [w if i not in (3, 4, 5, 8, 9, 13, 14) else "other" for i, w in enumerate(item)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "five words in this item"), (9, "too short"), (10, None), (11, "--")], "item_id long, text string")
    texts = [" ".join(noise + changed + other), "so: Five, words in this ITEM", "is that too-short?", " ".join(noise + beyond), None, "", " ".join(noise * 400 + changed + other * 400)]
    got = decontaminate.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()
    assert {tuple(r) for r in got} == {(0, 7, 30, 20, 17), (1, 8, 1, 5, 5), (2, 9, 2, 2, 2), (6, 7, 12000, 20, 17)}
    assert decontaminate.stretch(np.array([1, 0, 1, 1, 1, 1, 0, 0, 0, 1], bool)) == (0, 6)


def test_masks_find_every_pattern(spark):
    from itertools import combinations

    fits = lambda kept, m: any(all(kept[i + j] or k == "0" for j, k in enumerate(m)) for i in range(len(kept) - len(m) + 1))
    for n in range(1, 26):
        masks = decontaminate.SHORT.get(n, decontaminate.MASKS)
        for changed in combinations(range(n), n // 5):
            assert any(fits([i not in changed for i in range(n)], m) for m in masks), (n, changed)
    items, docs, want = [], [], set()
    for n in (5, 6, 7, 10, 11, 13, 15, 60):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for changed in combinations(range(n), n // 5) if n < 60 else [range(4, 60, 5)]:
            copy = ["other" if i in changed else w for i, w in enumerate(item)]
            want.add((len(docs), n, 20, n, n - len(changed)))
            docs.append((len(docs), " ".join([*map(str, range(1000, 1020)), *copy, *map(str, range(20))])))
    long = [f"long{i}" for i in range(40)]
    items.append((40, " ".join(long)))
    for changed in combinations(range(11, 22), 2):
        want.add((len(docs), 40, 20, 13, 11))
        docs.append((len(docs), " ".join([*map(str, range(20)), *("other" if i in changed else w for i, w in enumerate(long))][: 20] + ["other" if i in changed else w for i, w in enumerate(long)][10:23] + list(map(str, range(1000, 1020))))))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_decontamination_odd(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven"), (None, "ONE, two")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(odd_docs, some).collect()] == [(7, None, 0, 2, 2)]
    item = odd_docs.where("doc_id = 4").limit(1).select(F.lit(1).alias("item_id"), "text")
    assert sorted(r.doc_id or 0 for r in decontaminate.matches(odd_docs, item).collect()) == [0, 4, 4, 5]
    assert decontaminate.matches(odd_docs, none).count() == 0 and decontaminate.matches(no_docs, some).count() == 0


# -- packing and token output


def whole_ids(t):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in tok.encode_batch(t, add_special_tokens=False)]


def check_packed(rows, ids):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, want in ids.items():
        got = sorted(by[d], key=lambda r: r.start)
        at = 0
        for r in got:
            part = want[r.start : r.start + r.length]
            assert r.start == at and len(part) == r.length and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    return sum(n for own in bins.values() for _, n in own) / (len(bins) * packing.CAPACITY)


def test_packing(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op6_packing")
    ids = whole_ids([t or "" for _, t in texts])
    assert check_packed(rows, {d: [*i, 2] for (d, _), i in zip(texts, ids)}) > 0.97


def test_cuts():
    for n in [*range(1, 5000, 7), 4096, 8192, 100_000]:
        parts = packing.cuts(n)
        assert [s for s, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
        assert sum(x for _, x in parts) == n and max(x for _, x in parts) <= packing.CAPACITY
        assert len(parts) <= n // packing.CAPACITY + 6


def test_packing_odd(odd_docs, no_docs):
    rows = packing.pack(packing.pieces(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id != 4}
    ids = dict(zip(texts, whole_ids([t or "" for t in texts.values()])))
    for d, want in ids.items():
        got = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert [c for _, _, c in got] == [zlib.crc32(np.array([*want, 2][s : s + n], "<u4").tobytes()) for s, n, _ in got]
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def test_long_chunks_are_not_kept():
    import time

    w, b = tokens.WordEncoder(), tokens.ByteEncoder()
    for text in ("ab1" * 300_000, "日本語" * 100_000, "x" * 1_000_000):
        began = time.time()
        assert w.ids(text) and b.ids("lead " + text) and time.time() - began < 60
    assert all(len(k) <= tokens.LONGEST for d in (w, w.parts, b) for k in d)


def test_encoders_equal_the_library(texts):
    w, b = tokens.WordEncoder(), tokens.ByteEncoder()
    odd = ["", " ", "a  b", " lead", "trail ", "x\ty\n\nz", "don't I'LL we've", "ǅ Σας ΣΑΣ İstanbul é Å", "<|endoftext|> <|startoftext|>x", "a\x1cb \x85 c d", "naïve—test… 12345 6½", "!!??'s''s", "日本語 テスト 한국어", "É!! À,b _x_ 'tis ÿ÷×"]
    sample = odd + [t for _, t in texts[:200]]
    assert [np.frombuffer(w.ids(t), "<u4").tolist() for t in sample] == whole_ids(sample)
    assert [np.frombuffer(b.ids(t), "<u2").tolist() for t in sample] == [b.whole.encode_ordinary(t) for t in sample]


def test_token_output(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op10_token_output")
    enc = tokens.ByteEncoder().whole
    back = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == token_output.CAPACITY and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == 50256).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back[d][s] = ids[a:b].tolist()
    for d, t in texts:
        assert [x for s in sorted(back[d]) for x in back[d][s]] == [*enc.encode_ordinary(t), 50256]
    assert sum(r.n_tokens for r in rows) / (len(rows) * token_output.CAPACITY) > 0.95


def test_shards_round_trip(spark, documents, texts, tmp_path):
    """Matrix, lengths and resets from binary files give every document's ids back; writing again gives the same bytes."""
    enc, at = tokens.ByteEncoder().whole, tmp_path / "shards"
    index = token_output.write_shards(documents, str(at), block=50_000).collect()
    names = sorted(x.name for x in at.iterdir())
    first = {n: (at / n).read_bytes() for n in names}
    back = defaultdict(dict)
    for block in {r.block for r in index}:
        ids, lengths, resets = token_output.read_shard(str(at), block)
        for r in (x for x in index if x.block == block):
            assert lengths[r.row].tolist() == r.cu_seqlens and resets[r.row].tolist() == r.position_resets and zlib.crc32(ids[r.row].tobytes()) == r.ids_crc32
            for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
                back[d][s] = ids[r.row][a:b].tolist()
    assert len({r.block for r in index}) > 5
    for d, t in texts:
        assert [x for s in sorted(back[d]) for x in back[d][s]] == [*enc.encode_ordinary(t), 50256]
    token_output.write_shards(documents, str(at), block=50_000)
    assert {x.name: x.read_bytes() for x in at.iterdir()} == first
    (at / names[0]).write_bytes(b"")
    with pytest.raises(ValueError, match="bytes"):
        [token_output.read_shard(str(at), b) for b in {r.block for r in index}]


def test_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300).tolist()
    bins, free = token_output.best_fit(lengths, 100), []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):  # plain search
        fit = [(f, b) for b, f in enumerate(free) if f >= lengths[i]]
        if fit:
            free[min(fit)[1]] -= lengths[i]
        else:
            free.append(100 - lengths[i])
    assert sorted(100 - sum(lengths[i] for i in b) for b in bins) == sorted(free)


def test_token_output_odd(odd_docs, no_docs):
    enc, back = tokens.ByteEncoder().whole, defaultdict(list)
    for r in token_output.sequences(odd_docs).collect():
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back[d].append((s, ids[a:b]))
    for d, own in by_id(odd_docs).items():
        want = Counter((at, tuple(ids[at : at + token_output.CAPACITY])) for t in own for ids in [[*enc.encode_ordinary(t or ""), 50256]] for at in range(0, len(ids), token_output.CAPACITY))
        assert Counter((s, tuple(x)) for s, x in back[d]) == want
    assert token_output.sequences(no_docs).count() == 0


# -- quality rules


def brute_rules(t):
    w = re.findall(BLANK, t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(BLANK, x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in run(spark, sf_dir, "op7_quality_rules")}
    for d, t in texts:
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t), d
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    judged = [rows[d] for d in good if not rows[d].base_failed]
    assert sum(r.kept for r in judged) >= 0.99 * len(judged)


def brute_kept(rows):
    """Verdicts from plain sorting; ratios count as the middle of their bin."""
    middle = lambda x: 2 * quality_rules.BIN ** np.ceil(np.log(x) / np.log(quality_rules.BIN)) / (1 + quality_rules.BIN) if x > 0 else 0.0
    ok = [r for r in rows if not r.base_failed]
    quantile = lambda xs, q: sorted(xs)[max(0, int(np.ceil(q * len(xs))) - 1)]
    groups = [lambda r: (r.lang, r.source), lambda r: r.lang, lambda r: 0]
    by = [defaultdict(list) for _ in groups]
    for r in ok:
        for g, key in zip(by, groups):
            g[key(r)].append(r)
    quantiles = {(id(pool), c): [middle(x[c] / max(x[e], 1)) for x in pool] for g in by for pool in g.values() for c, e, _, _ in quality_rules.RATIOS.values()}
    out = {}
    for r in rows:
        fits = [g[key(r)] for g, key in zip(by, groups)]
        pool = next((x for x in fits if len(x) >= quality_rules.LEAST_ROWS), fits[-1])
        worst = -np.inf
        for c, e, unit, q in quality_rules.RATIOS.values() if pool else ():
            xs, n = quantiles[id(pool), c], max(r[e], 1)
            spread = quantile(xs, 0.75) - quantile(xs, 0.25)
            for side, sign in ((quantile(xs, q), 1), (quantile(xs, 1 - q), -1)):
                worst = max(worst, sign * (r[c] - side * n) - 3 * (spread * n + unit * np.sqrt(side * n / unit + 1)))
        out[r.doc_id] = (not r.base_failed and worst <= 0, worst)
    return out


def test_adaptive_bounds(spark, documents):
    made = []
    for i in range(1200):  # two sources with habits of their own, and a few rows of a third
        source, bars = ("wiki", 0) if i % 2 else ("code", 12)
        made.append((100_000 + i, " ".join([f"w{i}x{j}" for j in range(60)] + ["|"] * (bars + i % 3)), "en", source, 1))
    made += [(200_000, " ".join([f"w999x{j}" for j in range(60)] + ["|"] * 25), "en", "wiki", 1), (200_001, " ".join([f"w999x{j}" for j in range(60)] + ["|"] * 25), "en", "code", 1)]
    lines = [f"a line of its own number {j} here" for j in range(30)]
    made += [(200_002, "\n".join(lines + lines[:12]), "en", "wiki", 1), (200_003, " ".join(["x" * 40] * 3 + [f"{'y' * 30}{j}" for j in range(40)]), "en", "wiki", 1), (200_004, "z " * 10, "en", "third", 1)]
    made += [(200_005, " ".join(f"q{j}" for j in range(300)) + " " + " ".join(f"q{j}" for j in range(35)), "en", "wiki", 1)]
    df = documents.unionByName(spark.createDataFrame(made, documents.schema))
    rows = quality_rules.judged(df).collect()
    want = brute_kept(rows)
    sure = [r for r in rows if r.base_failed or abs(want[r.doc_id][1]) > 1e-6]
    bad = [(r, want[r.doc_id]) for r in sure if r.kept != want[r.doc_id][0]]
    assert not bad and len(sure) > 0.9 * len(rows), (len(bad), bad[:2], len(sure), len(rows))
    by = {r.doc_id: r for r in rows}
    assert by[200_001].kept and "symbols_per_word" in by[200_000].beyond
    assert "dup_line_share" in by[200_002].beyond and "mean_word_chars" in by[200_003].beyond and "repeat_share" in by[200_005].beyond and not by[200_005].base_failed
    assert len({str(r.symbols_per_word_bounds) for r in rows}) > 2
    again = {r.doc_id: r.kept for r in quality_rules.judged(df.repartition(5, "text")).collect()}
    assert again == {r.doc_id: r.kept for r in rows}


def test_quality_rules_odd(odd_docs, no_docs):
    rows = quality_rules.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        t = [x.text for x in odd_docs.select("doc_id", "text").collect() if x.doc_id == r.doc_id][0] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t)
    assert quality_rules.judged(no_docs).count() == 0


# -- classifier


def test_classifier(spark, sf_dir):
    rows = {r.doc_id: r for r in run(spark, sf_dir, "op8_classifier")}
    labels = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in rows and r.quality is not None]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(q, r.predicted) for q, r in labels if r.held_out]
    assert sum(q == p for q, p in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_machine_identity():
    rng = np.random.default_rng(3)
    m = classifier.Machine(0.1, rng.normal(size=classifier.SIZE), rng.normal(size=(classifier.SIZE, 4)) * 0.1)
    ids, x = np.array([3, 9, 77, 500]), np.array([1.0, 0.5, 2.0, 0.1])
    z = 0.1 + m.linear[ids] @ x + sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.score(ids, x) - 1 / (1 + np.exp(-z))) < 1e-9


def test_classifier_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    m = classifier.train(odd_docs, labels)
    for d, own in by_id(odd_docs).items():
        got = sorted(r.score for r in classifier.scored(odd_docs, m).where(F.col("doc_id").eqNullSafe(d)).collect())
        assert got == pytest.approx(sorted(m.score(*classifier.features((t or "").encode())) for t in own)) and all(0 <= x <= 1 for x in got)
    assert classifier.scored(no_docs, classifier.train(no_docs, labels.limit(0))).count() == 0
    kept = classifier.scored(odd_docs.withColumn("quality_score", F.lit("clash")), m, keep=True)
    assert kept.columns == [*odd_docs.columns, "quality_score"] and kept.where("quality_score between 0 and 1").count() == odd_docs.count()


def test_classifier_reads_one_text_of_an_id(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("cast(id % 3 as long) as doc_id", "concat('text ', id % 7, ' of it') as text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    monkeypatch.setattr(classifier, "fit", lambda rows, labels: (len(rows), sorted(labels)))
    assert classifier.train(docs, labels) == (2, [0.0, 1.0])


# -- suffix dedup


def brute_removed(texts, span=200):
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(b[i : i + span] for _, b in raw for i in range(len(b) - span + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_suffix_dedup(spark, sf_dir, texts):
    got = [tuple(r) for r in run(spark, sf_dir, "op9_suffix_dedup")]
    want = brute_removed(texts)
    assert order(got) == order(want)
    assert sum(r[2] > 0 for r in want) > 50


def test_suffix_dedup_hard(spark):
    rng = np.random.default_rng(2)
    some = lambda n, k=3: bytes(rng.integers(97, 97 + k, n).astype(np.uint8)).decode()
    shared = some(260)
    rows = [(i, some(int(rng.integers(0, 90))) + shared[int(rng.integers(0, 40)) :] + some(int(rng.integers(0, 200)), 2)) for i in range(150)]
    rows += [(200, "ab" * 500), (201, "b" + "ab" * 130), (202, "x" * 700), (203, some(1000) * 2), (204, "é" * 150), (205, "é" * 120), (206, shared), (207, "ab" * 500), (208, some(600_000, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = order(brute_removed(rows))
    for hot_entries in (suffix_dedup.HOT_ENTRIES, 60, 0):
        assert order(tuple(r) for r in suffix_dedup.deduplicated(df, hot_entries=hot_entries).collect()) == want


def test_suffix_dedup_tells_equal_keys_apart(spark, documents, texts, monkeypatch):
    """Unlike texts whose first key is equal are keyed anew."""
    monkeypatch.setattr(suffix_dedup, "text_keys", lambda text: (F.crc32(text.cast("binary")) % 700, F.xxhash64(F.lit("second"), text)))
    assert order(tuple(r) for r in suffix_dedup.deduplicated(documents).collect()) == order(brute_removed(texts))


def test_shared_windows_of_large_groups():
    rng = np.random.default_rng(9)
    some = lambda n: bytes(rng.integers(97, 99, n).astype(np.uint8))
    gram, heads, tails = some(48), [some(152) for _ in range(4)], [some(152) for _ in range(4)]
    group = set()
    while len(group) < 200:
        b, s = int(rng.integers(0, 153)), int(rng.integers(0, 153))
        head, tail = bytearray(heads[int(rng.integers(4))]), bytearray(tails[int(rng.integers(4))])
        head[int(rng.integers(60))] ^= 1
        tail[int(rng.integers(90, 152))] ^= 1
        group.add((gram + bytes(tail)[:s], bytes(head)[len(head) - b :], False))
    group = [x for x in sorted(group) if len(x[0]) + len(x[1]) >= 200]
    shared = [0] + [suffix_dedup.common(a[0], b[0]) for a, b in zip(group, group[1:])]
    seen = Counter((el, b[len(b) - el :] + s[: 200 - el]) for s, b, _ in group for el in range(max(0, 200 - len(s)), len(b) + 1))
    want = [sum(1 << el for el in range(max(0, 200 - len(s)), len(b) + 1) if seen[el, b[len(b) - el :] + s[: 200 - el]] > 1) for s, b, _ in group]
    assert suffix_dedup.shared_windows(group, shared) == want and any(want) and len(group) > 24


def test_suffix_dedup_hot(documents, texts, monkeypatch):
    """All buckets by windows, and runs cut small: the same rows."""
    monkeypatch.setattr(suffix_dedup, "RUN_ENTRIES", 1000)
    want = order(brute_removed(texts))
    for hot_entries in (suffix_dedup.HOT_ENTRIES, 0):
        assert order(tuple(r) for r in suffix_dedup.deduplicated(documents, hot_entries=hot_entries).collect()) == want


def test_suffix_dedup_odd(odd_docs, no_docs):
    got = [tuple(r) for r in suffix_dedup.deduplicated(odd_docs).collect()]
    assert order(got) == order(brute_removed([(r.doc_id, r.text) for r in odd_docs.collect()]))
    kept = suffix_dedup.deduplicated(odd_docs, keep_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)
    assert suffix_dedup.deduplicated(no_docs).count() == 0


def test_merge_and_coding():
    rng = np.random.default_rng(4)
    runs = [sorted({(bytes(rng.integers(97, 99, int(rng.integers(1, 30))).astype(np.uint8)), b"p", False) for _ in range(40)}) for _ in range(7)] + [[]]
    blobs = [suffix_dedup.encoded(r) for r in runs]
    assert [[x[1:] for x in suffix_dedup.decoded(b)] for b in blobs] == runs
    out = list(suffix_dedup.merged([suffix_dedup.decoded(b) for b in blobs]))
    assert [x[1] for x in out] == sorted(s for r in runs for s, _, _ in r)
    assert [x[0] for x in out[1:]] == [suffix_dedup.common(a[1], b[1]) for a, b in zip(out, out[1:])]
