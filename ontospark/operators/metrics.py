"""Binary, multi-label and distribution metrics (A6-A15, A23, W5, F8) as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.operators.order import ranged
from ontospark.runtime import Stash


def threshold_grid(spark, points: int = 94, step: float = 0.01) -> DataFrame:
    """``0.01 + i * 0.01``, with the floating-point drift of that sum."""
    return spark.range(points).select(F.col("id").alias("pos"), (F.lit(step) + F.col("id") * F.lit(step)).alias("threshold"))


def sweep(scored: DataFrame, thresholds: list[float], score: str = "score", truth: str = "y") -> DataFrame:
    """``(threshold, tp, fp, tn, fn, accuracy, precision, recall, f1)`` at strict ``score > threshold``: rows are counted once by how
    many thresholds they pass, thresholds then read sums over those counts. Division by zero gives 0; null scores or truths are left out."""
    cuts = sorted(set(thresholds))
    passed = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("s")))
    counts = scored.select(F.col(score).alias("s"), F.col(truth).cast("int").alias("t")).filter("s is not null and t is not null").groupBy(passed.alias("b")).agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    return sweep_counts(counts, cuts)


def sweep_counts(counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """:func:`sweep` from ``(b, pos, neg)``: rows by how many of the ascending thresholds they pass."""
    cuts = sorted(set(thresholds))
    base = counts.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(cuts, 1)] + [(0, None)], "b int, threshold double")
    # at most one row per threshold, so one window over all of them is small
    every = base.join(F.broadcast(counts), "b", "left").fillna(0, ["pos", "neg"])
    up = Window.partitionBy().orderBy("b").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    low = Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    c = every.select("threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.coalesce(F.sum("neg").over(low), F.lit(0)).alias("tn"), F.coalesce(F.sum("pos").over(low), F.lit(0)).alias("fn")).filter("threshold is not null")
    return with_ratios(c)


def with_ratios(c: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to rows with tp, fp, tn and fn; division by zero gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    acc = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.withColumns({"accuracy": acc, "precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_thresholds(swept: DataFrame) -> DataFrame:
    """``(metric, threshold, value)``: the smallest threshold that reaches each metric's maximum."""
    names = ["accuracy", "precision", "recall", "f1"]
    long = swept.select("threshold", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m"))
    return long.groupBy("m.metric").agg(F.min_by("threshold", F.struct(-F.col("m.value"), "threshold")).alias("threshold"), F.max("m.value").alias("value"))


def roc_auc(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """``(auc, pos, neg)`` with ties averaged; one class only gives 0. Rows are first counted by distinct score."""
    rows = scored.select(F.col(score).cast("double").alias("s"), F.col(truth).cast("long").alias("t")).filter("s is not null and t is not null")
    return auc_of_counts(rows.groupBy("s").agg(F.sum("t").alias("p"), F.sum(1 - F.col("t")).alias("n")))


def auc_of_counts(by: DataFrame) -> DataFrame:
    """``(auc, pos, neg)`` from ``(s, p, n)``: positives and negatives at each distinct score, summed range by range of scores, so that
    no single task sorts them all."""
    by = Stash(by.sparkSession, "auc").put(ranged(by, "s", "part"))
    # one row per range
    before = by.groupBy("part").agg(F.sum("n").alias("pn")).select("part", F.coalesce(F.sum("pn").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = by.join(F.broadcast(before), "part").withColumn("below", F.col("base") + inner)
    total = u.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("neg"))
    return total.select(F.coalesce(F.try_divide("u", F.col("pos") * F.col("neg")), F.lit(0.0)).alias("auc"), "pos", "neg")


def weighted_bce(scored: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """Class means of -log p and -log(1-p), each divided by its class count again; logs end at -100."""
    log = lambda c: F.greatest(F.when(c > 0, F.log(c)).otherwise(-100.0), F.lit(-100.0))
    one, zero = F.when(F.col(truth) == 1, -log(F.col(score))), F.when(F.col(truth) == 0, -log(1 - F.col(score)))
    a = scored.agg(F.avg(one).alias("a"), F.avg(zero).alias("b"), F.count(one).alias("n1"), F.count(zero).alias("n0"))
    return a.select((F.coalesce(F.try_divide("a", "n1"), F.lit(0.0)) + F.coalesce(F.try_divide("b", "n0"), F.lit(0.0))).alias("loss"), "n1", "n0")


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return df.agg(F.count(s).alias("n"), F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))


def histogram(df: DataFrame, score: str = "score", bins: int = 50) -> DataFrame:
    """``(bin, n)``: equal-width bins from the minimum to the maximum, which belongs to the last."""
    edge = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(score).isNotNull()).join(F.broadcast(edge)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, score: str = "score") -> DataFrame:
    """``(score, share)``: share of rows at or below each distinct score, from counts."""
    return ecdf_of_counts(df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n")))


def ecdf_of_counts(n: DataFrame) -> DataFrame:
    """:func:`ecdf` from ``(score, n)``, summed range by range of scores."""
    n = ranged(n, "score", "part")
    part = n.groupBy("part").agg(F.sum("n").alias("pn"))
    # one row per range
    over = Window.partitionBy().orderBy("part")
    part = part.select("part", (F.sum("pn").over(over) - F.col("pn")).alias("base"), F.sum("pn").over(Window.partitionBy()).alias("all"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("score"))
    return n.join(F.broadcast(part), "part").select("score", (upto / F.col("all")).alias("share"))


def percentile(df: DataFrame, share: float, score: str = "score") -> DataFrame:
    return df.agg(F.percentile(score, share).alias("cut"))


def set_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(jaccard, f1, exact)``: means over rows of set agreement; two empty sets agree fully, nulls are empty sets."""
    t, g = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in (truth, guess))
    rows = df.select(t.alias("t"), g.alias("g"))
    both, one = F.size(F.array_intersect("t", "g")), F.size(F.array_union("t", "g"))
    empty = one == 0
    jac = F.when(empty, 1.0).otherwise(both / F.greatest(one, F.lit(1)))
    f1 = F.when(empty, 1.0).otherwise(2 * both / F.greatest(F.size("t") + F.size("g"), F.lit(1)))
    return rows.agg(F.avg(jac).alias("jaccard"), F.avg(f1).alias("f1"), F.avg((both == one).cast("double")).alias("exact"), F.count("*").alias("n"))


def label_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(precision, recall, f1)`` of each label, averaged by its support."""
    long = df.select(F.explode(F.array_union(truth, guess)).alias("label"), F.col(truth).alias("t"), F.col(guess).alias("g"))
    hit = long.select("label", F.array_contains("t", F.col("label")).cast("int").alias("t"), F.array_contains("g", F.col("label")).cast("int").alias("g"))
    per = hit.groupBy("label").agg(F.sum(F.col("t") * F.col("g")).alias("tp"), F.sum("t").alias("support"), F.sum("g").alias("guessed"))
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    per = per.withColumns({"p": p, "r": r}).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    avg = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return per.agg(avg("p").alias("precision"), avg("r").alias("recall"), avg("f").alias("f1"), F.sum("support").alias("support"))


def pick_labels(scores: DataFrame, key: str, label: str, score: str, above: float = 0.3) -> DataFrame:
    """``(key, labels)``: labels over the threshold, else the single best one (F8)."""
    over = F.sort_array(F.collect_set(F.when(F.col(score) > above, F.col(label))))
    return scores.groupBy(key).agg(over.alias("o"), F.min_by(label, F.struct(-F.col(score), F.col(label))).alias("b")).select(key, F.when(F.size("o") > 0, F.col("o")).otherwise(F.array("b")).alias("labels"))
