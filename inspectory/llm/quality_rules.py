"""Quality rules with adaptive thresholds, in DataFrame operations only.

Counts of each whole text are made first. Their ratios go into quantile sketches for each language and source: numbers of
rows by logarithmic bins of 2 % width, which merge by addition and give the same quantiles in whatever order rows come, so
a run that is repeated judges alike. A group of few rows takes the merged sketch of its language, or of all. Rows that
fail the base rule do not shape what is usual.

A count is out of bounds beyond its group's outer quantile by three times the middle half's spread and three times what
counting alone scatters (the square root of the expected number of occurrences and one more), so a single mark in a short
text decides nothing. The bounds join back to the documents by language and source (broadcast while their number is
small, else merge-joined).

A null text has no words; a text with fewer than 20 words fails the base rule. Null languages and sources form groups of
their own. Repeated rows and ties are judged one by one. Very long texts are counted whole. An empty table gives no rows.
Of further columns, clashing names included, none is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLANKS, WINDOW, FENCE, FEW_GROUPS = " \t\n\x0b\x0c\r", 8, 3.0, 50_000
LEAST_ROWS, BIN = 200, 1.02
BLANK_RUN = r"[ \t\n\x0B\f\r]+"
#: What is judged: a count, what it is measured by, how much one occurrence counts, and the outer quantile (its counterpart bounds from below).
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words", 1, 0.9), "dup_line_share": ("n_dup_lines", "n_lines", 1, 0.9),
    "repeat_share": ("n_repeat_words", "n_words", 2 * WINDOW, 0.9), "mean_word_chars": ("word_chars", "n_words", 1, 0.75),
}
LEVELS = (("lang", "source"), ("lang",), ())


def split_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), "lang", "source", text.alias("t"))
    df = df.withColumn("w", split_words(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    starts = F.sequence(F.lit(1), F.size("h") - (WINDOW - 1))
    df = df.withColumn("win", F.when(F.size("h") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("again", F.size(F.array_distinct("win")) < F.size("win"))
    df = df.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, i: (F.get("s", i - 1)["x"].eqNullSafe(e["x"])) | (F.get("s", i + 1)["x"].eqNullSafe(e["x"]))
    df = df.withColumn("p", F.when(F.col("again"), F.array_sort(F.transform(F.filter("s", same), lambda e: e["i"]))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate("p", start, lambda a, x: F.struct(x.alias("last"), (a["covered"] + F.least(F.lit(WINDOW), x - a["last"])).alias("covered")), lambda a: a["covered"])
    return df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def named(*keys: str) -> list[Column]:
    """Group keys without nulls, so that they can be joined."""
    return [F.when(F.col(k).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(k).cast("string"))).alias(k) for k in keys]


def sketches(df: DataFrame) -> DataFrame:
    """lang, source, ratio, bin (null: zero) and n. Sketches of several tables merge by adding n."""
    ratio = lambda c, e: F.col(c) / F.greatest(F.col(e), F.lit(1))
    each = F.array(*(F.struct(F.lit(r).alias("ratio"), ratio(c, e).alias("v")) for r, (c, e, _, _) in RATIOS.items()))
    rows = df.where(~base_failed()).select(*named("lang", "source"), F.explode(each).alias("x"))
    number = F.when(F.col("x.v") > 0, F.ceil(F.log(F.col("x.v")) / F.log(F.lit(BIN)))).cast("int")
    return rows.groupBy("lang", "source", F.col("x.ratio").alias("ratio"), number.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sk: DataFrame, level: tuple[str, ...]) -> DataFrame:
    """The level's keys, ratio, rows, and low, high (outer quantiles) and spread (of the middle half) of the merged sketches."""
    by = [*level, "ratio"]
    merged = sk.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.asc_nulls_first("bin"))  # bins of a group: some hundreds
    merged = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(Window.partitionBy(*by)))
    value = F.coalesce(2 * F.pow(F.lit(BIN), F.col("bin")) / (1 + BIN), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), value))
    outer = F.lit(None).cast("double")
    for r, (_, _, _, q) in RATIOS.items():
        outer = F.when(F.col("ratio") == r, q).otherwise(outer)
    merged = merged.withColumn("outer", outer)
    return merged.groupBy(*by).agg(F.first("rows").alias("rows"), at(1 - F.col("outer")).alias("low"), at(F.col("outer")).alias("high"), (at(F.lit(0.75)) - at(F.lit(0.25))).alias("spread"))


def bounds(sk: DataFrame) -> DataFrame:
    """lang, source and, for each ratio, a struct of low, high and spread: the group's own, its language's or all rows'."""
    own, lang, whole = (written(quantiles(sk, level), "quantiles") for level in LEVELS)
    up = lambda df, p: df.withColumnsRenamed({c: p + c for c in ("rows", "low", "high", "spread")})
    df = own.join(up(lang, "l_").hint("merge"), ["lang", "ratio"]).join(F.broadcast(up(whole, "w_")), "ratio")  # one row a ratio
    pick = lambda c: F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("l_rows") >= LEAST_ROWS, F.col("l_" + c)).otherwise(F.col("w_" + c)).alias(c)
    df = df.withColumn("b", F.struct(*map(pick, ("low", "high", "spread"))))
    return df.groupBy("lang", "source").agg(*(F.first(F.when(F.col("ratio") == r, F.col("b")), ignorenulls=True).alias(f"{r}_bounds") for r in RATIOS))


def within(ratio: str) -> Column:
    """True if a row's count lies inside the bounds of its group (or there are none)."""
    count, measure, unit, _ = RATIOS[ratio]
    b, e = F.col(f"{ratio}_bounds"), F.greatest(F.col(measure), F.lit(1)).cast("double")
    room = lambda side: FENCE * (b["spread"] * e + unit * F.sqrt(b[side] * e / unit + 1))
    return F.coalesce(F.col(count).between(b["low"] * e - room("low"), b["high"] * e + room("high")), F.lit(True))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, bounds, base_failed, which ratios are within bounds, and kept for each document."""
    rows = written(counted(docs, id_col, text_col), "counted")
    limits = written(bounds(written(sketches(rows), "sketches")), "bounds").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    limits = F.broadcast(limits) if limits.count() <= FEW_GROUPS else limits.hint("merge")
    lang, source = named("lang", "source")
    df = rows.join(limits, (lang == F.col("lang_")) & (source == F.col("source_")), "left")
    ok = F.array(*(F.when(~within(r), F.lit(r)) for r in RATIOS))
    df = df.withColumn("base_failed", base_failed()).withColumn("beyond", F.array_compact(ok))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
