"""Each stage of the pipeline against its operator's own rule, on its own input."""

from collections import Counter

import numpy as np

import corpus_pipeline as cp
from inspectory.llm import classifier, secrets

from .test_operators import brute_groups


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    for name, stage in cp.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == cp.COLUMNS, name
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name == "quality classifier":
            assert len(good & ids) >= 0.98 * len(good & {r.doc_id for r in before})
        elif name == "near duplicates":
            assert ids == {d for d, (_, c) in brute_groups([(r.doc_id, r.text) for r in before], 5).items() if d == c}
        elif name == "secret scan":
            assert ids == {r.doc_id for r in before}
            text = {r.doc_id: r.text for r in before}
            assert all(r.text == secrets.redacted(text[r.doc_id]) and r.n_chars == len(r.text) for r in after)
        else:
            assert len(ids) < len(before)
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_odd_rows(spark, tmp_path, monkeypatch):
    """Repeated rows, equal ids with unlike texts, nulls, empties, a long text, clashing columns: each stage by its rule, row by row."""
    from pyspark.sql import functions as F

    from .test_operators import brute_matches, whole_ids

    rng = np.random.default_rng(12)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    a, b, c, e, f, long = prose(80), prose(80), prose(80), prose(80), prose(80), prose(20_000)
    item = prose(30)
    leak = f"{prose(40)} {item} {prose(10)}"
    secret = prose(30) + " password=hunter2hunter2 " + prose(10)
    rows = [(3, a), (5, b), (5, b), (9, a + " more"), (9, c), (None, e), (None, e), (None, a), (7, leak), (7, f), (8, secret), (8, secret + " x"), (11, ""), (12, None), (13, long), (14, long)]
    rows = [(d, t, None if d == 3 else "en", None if d == 9 else "s", None if t is None else len(t)) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = df.withColumns({n: F.lit("clash") for n in ("quality_score", "row", "h1", "h2", "key", "rep", "score", "label", "bucket", "head", "carried")})
    monkeypatch.setattr(cp.classifier, "THRESHOLD", 0.0)
    for name, part, kind in (("labels", [(3, 1), (5, 0), (5, 0), (None, 1)], "doc_id long, quality int"), ("benchmark", [(1, item), (2, None), (3, "")], "item_id long, text string")):
        spark.createDataFrame(part, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda rs: sorted(map(str, (tuple(r) for r in rs)))
    one = cp.quality(spark, clash, str(tmp_path))
    assert one.columns == cp.COLUMNS and key(one.collect()) == key(rows)
    two = cp.near_duplicate(spark, one, str(tmp_path))
    want = [rows[i] for i in (0, 1, 4, 5, 8, 9, 10, 12, 13, 14)]
    assert two.columns == cp.COLUMNS and key(two.collect()) == key(want)
    three = cp.decontamination(spark, two, str(tmp_path))
    held = {i for i, _ in brute_matches([(0, r[1]) for r in want], [(1, item)])}
    want = [r for i, r in enumerate(want) if i not in held]
    assert key(three.collect()) == key(want) and len(held) == 1
    four = cp.secret_scan(spark, three, str(tmp_path)).collect()
    want = [(d, secrets.redacted(t), lang, s, len(secrets.redacted(t))) if t is not None else (d, t, lang, s, n) for d, t, lang, s, n in want]
    assert key(four) == key(want) and not any("hunter2" in (r.text or "") for r in four)
    ids = whole_ids([t or "" for _, t, *_ in want])
    packed = cp.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(i) + 1 for i in ids)
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == Counter((d, len(i) + 1) for (d, *_), i in zip(want, ids))


def test_empty_table(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_threshold():
    assert classifier.THRESHOLD == 0.3 and len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
