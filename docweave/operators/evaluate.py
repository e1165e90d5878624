"""Measures of matching and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("exact", "fuzzy", "semantic", "none")


def count_where(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, 100.0 * a / b).otherwise(F.lit(0.0))


def quality_summary(flags: DataFrame) -> DataFrame:
    """total, and of each boolean column its count and percentage."""
    n = F.count("*")
    each = [x for c in flags.columns for x in (count_where(F.col(c)).alias(c), F.round(percent(count_where(F.col(c)), n), 4).alias(f"{c}_pct"))]
    return flags.agg(n.alias("total"), *each)


def overall(rows: DataFrame, *by: str) -> DataFrame:
    """total, correct, false_positive, no_match of rows(matched, correct), in all or by columns."""
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), count_where(F.col("correct")).alias("correct"), count_where(F.col("matched") & ~F.col("correct")).alias("false_positive"), count_where(~F.col("matched")).alias("no_match"))
    return out.withColumn("accuracy", F.round(percent(F.col("correct"), F.col("total")), 4))


def confusion(rows: DataFrame) -> DataFrame:
    """A row for each expected tier, a column for each actual one; absent pairs are 0."""
    return rows.groupBy("expected_tier").pivot("actual_tier", list(TIERS)).count().na.fill(0)


def tier_scores(rows: DataFrame) -> DataFrame:
    """tier, tp, fp, fn and percentages of precision, recall and F1: hits count to the tier that answered, misses to the one expected."""
    got = rows.where("matched").groupBy(F.col("actual_tier").alias("tier")).agg(count_where(F.col("correct")).alias("tp"), count_where(~F.col("correct")).alias("fp"))
    missed = rows.groupBy(F.col("expected_tier").alias("tier")).agg(count_where(~F.col("correct")).alias("fn"))
    both = got.join(missed, "tier", "full").na.fill(0).where(F.col("tier") != "none")
    p, r = percent(F.col("tp"), F.col("tp") + F.col("fp")), percent(F.col("tp"), F.col("tp") + F.col("fn"))
    return both.select("tier", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 4).alias("f1"))


def routing(rows: DataFrame) -> DataFrame:
    """Metrics of rows(stage, expected, actual, status), a row for each stage and one for all (stage null)."""
    right, filed = F.col("actual") == F.col("expected"), F.col("status") == "filed"
    right = F.coalesce(right, F.lit(False))
    n_filed = count_where(filed)
    aggs = [F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 4).alias("matter_accuracy"), F.round(F.when(n_filed > 0, count_where(filed & right) / n_filed), 4).alias("autofile_precision"), F.round(count_where(filed & right) / F.count("*"), 4).alias("autofile_recall"), F.round(count_where(~filed) / F.count("*"), 4).alias("review_rate"), count_where(filed & ~right).alias("harmful_error_count")]
    return rows.groupingSets([[], [F.col("stage")]], F.col("stage")).agg(*aggs)


def order_statistics(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the value at floor(share * n) in ascending order, not interpolated. Equal values are counted first, so that a group costs its distinct values; the order is a window over those."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(by)
    placed = counts.withColumns({"upto": F.sum("n").over(own.orderBy(value)), "all": F.sum("n").over(own)})
    at = {k: F.min(F.when(F.col("upto") > F.floor(F.col("all") * F.lit(share)), F.col(value))) for k, share in shares.items()}
    return placed.groupBy(by).agg(*(x.alias(k) for k, x in at.items()))


def calibration(rows: DataFrame) -> DataFrame:
    """n and correct by confidence in steps of a twentieth (halves to even)."""
    return rows.where("confidence is not null").groupBy((F.bround(F.col("confidence").cast("double") * 20) / 20).alias("band")).agg(F.count("*").alias("n"), count_where(F.col("correct")).alias("correct"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """both, only_a, only_b, neither over documents that both have: by stage and in all (stage null)."""
    x = a.select("doc_id", "stage", F.col("correct").alias("a")).join(b.select("doc_id", F.col("correct").alias("b")), "doc_id")
    return x.groupingSets([[], [F.col("stage")]], F.col("stage")).agg(count_where(F.col("a") & F.col("b")).alias("both_right"), count_where(F.col("a") & ~F.col("b")).alias("only_a"), count_where(~F.col("a") & F.col("b")).alias("only_b"), count_where(~F.col("a") & ~F.col("b")).alias("neither"))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of discordant counts; 1 if there are none."""
    n, low = b + c, F.least(b, c)
    upto = lambda first: F.sequence(F.lit(first).cast("long"), F.greatest(low, F.lit(1)))
    # the last term of the tail, and the sum of all as a multiple of it, from the last one down
    last = F.exp(F.aggregate(upto(1), F.lit(0.0), lambda s, i: s + F.when(i <= low, F.log((n - low + i) / i)).otherwise(F.lit(0.0))) - n * F.log(F.lit(2.0)))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def down(s: Column, i: Column) -> Column:
        k = low - i + 1
        term = F.when(k > 0, s["term"] * k / (n - k + 1)).otherwise(F.lit(0.0))
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    tail = last * F.aggregate(upto(1), start, down)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def by_category(rows: DataFrame, category: str) -> DataFrame:
    """n, correct, unmatched and accuracy (one decimal) of rows(correct, matched) in each category."""
    n = F.count("*")
    return rows.groupBy(category).agg(n.alias("n"), count_where(F.col("correct")).alias("correct"), count_where(~F.col("matched")).alias("unmatched"), F.round(count_where(F.col("correct")) * 100.0 / n, 1).alias("accuracy"))


def page_bucket(n_pages: Column) -> Column:
    return F.when(n_pages <= 15, "1-15").when(n_pages <= 30, "16-30").otherwise(">30")


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Median, least and most of runs' mean latency, and whether all runs are equally accurate. runs(run, correct, route_ms)."""
    each = runs.groupBy(*by, "run").agg(F.avg("route_ms").alias("ms"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    return each.groupBy(*by).agg(F.round(F.median("ms"), 4).alias("median_ms"), F.round(F.min("ms"), 4).alias("min_ms"), F.round(F.max("ms"), 4).alias("max_ms"), (F.min("accuracy") == F.max("accuracy")).alias("same_accuracy"))


def outcome(matched: Column, correct: Column) -> Column:
    return F.when(~matched, "no_match").when(correct, "correct").otherwise("false_positive")


def by_position(rows: DataFrame, key: Column, shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """rows with `position` (from 1) in the order of key's digest, and `share`, the label whose part of all positions it falls in.

    Positions are global but no task sees all rows: digests are dealt by their leading digits into buckets, whose counts
    (at most `buckets` rows) give each bucket its offset.
    """
    keyed = rows.withColumn("digest", F.md5(key)).withColumn("bucket", F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") * buckets / (1 << 24))
    keyed = keyed.withColumn("bucket", F.floor("bucket"))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(Window.partitionBy())})
    placed = keyed.join(F.broadcast(counts.select("bucket", "before", "total")), "bucket")
    placed = placed.withColumn("position", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("digest")))
    label, upto = F.lit(None).cast("string"), 0.0
    for name, part in shares.items():
        upto += part
        label = F.coalesce(label, F.when(F.col("position") <= F.floor(F.col("total") * F.lit(round(upto, 9))), F.lit(name)))
    return placed.withColumn("share", F.coalesce(label, F.lit(list(shares)[-1]))).drop("digest", "bucket", "before", "total")
