"""Training logs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.operators.order import numbered


def moving_average(log: DataFrame, group: str, step: str, value: str, width: int | None = None) -> DataFrame:
    """Averages over full windows of ``width`` steps; None: a twentieth of the group's steps, at least 5, and none for up to 10 steps."""
    w = Window.partitionBy(group).orderBy(step)
    if width is None:
        return _own_width(log, group, step, value)
    return log.select(group, step, F.avg(value).over(w.rowsBetween(1 - width, 0)).alias("average"), F.row_number().over(w).alias("n")).filter(F.col("n") >= width).drop("n")


def _own_width(log: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """Windows whose width differs by group: sums up to a step less those up to ``width`` steps before, found by position."""
    w = Window.partitionBy(group).orderBy(step)
    rows = log.select(group, step, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"), F.row_number().over(w).alias("_n"))
    size = log.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_all"))
    rows = rows.join(F.broadcast(size), F.col(group).eqNullSafe(F.col("_g"))).filter("_all > 10").withColumn("_w", F.greatest(F.lit(5), F.floor(F.col("_all") / 20)))
    back = rows.select(F.col(group).alias("_bg"), (F.col("_n") + F.col("_w")).alias("_bn"), F.col("_s").alias("_bs"))
    both = rows.filter("_n >= _w").join(back, F.col(group).eqNullSafe(F.col("_bg")) & (F.col("_n") == F.col("_bn")), "left")
    return both.select(group, step, ((F.col("_s") - F.coalesce("_bs", F.lit(0.0))) / F.col("_w")).alias("average"))


def running_best(log: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """Steps whose value beats all before them."""
    best = F.max(value).over(Window.partitionBy(group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return log.select(group, step, value, best.alias("before")).filter(F.col("before").isNull() | (F.col(value) > F.col("before"))).drop("before")


def last_steps(log: DataFrame, group: str, step: str, n: int = 50) -> DataFrame:
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(step).desc()))).filter(F.col("_r") <= n).drop("_r")


def keep_top(log: DataFrame, group: str, score: str, step: str, k: int = 2) -> DataFrame:
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(step).desc()))).filter(F.col("_r") <= k).drop("_r")


def log_summary(log: DataFrame, group: str, step: str, value: str) -> DataFrame:
    return log.groupBy(group).agg(F.count("*").alias("n"), F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def nearest_step(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """Each left row with the right row of its key nearest in ``at`` (a number); ties go to the earlier. One union and two windows
    instead of a range join."""
    rows = left.select(key, at, F.lit(0).alias("side"), F.col("value").alias("lv"), F.lit(None).cast("struct<at:double,value:double>").alias("r")).unionByName(
        right.select(key, at, F.lit(1).alias("side"), F.lit(None).cast("double").alias("lv"), F.struct(F.col(at).cast("double").alias("at"), F.col("value").cast("double").alias("value")).alias("r")))
    w = Window.partitionBy(key).orderBy(at, F.col("side").desc())
    near = rows.withColumns({"prev": F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first("r", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).filter("side = 0")
    later = F.col("prev").isNull() | (F.col("next").isNotNull() & (F.col("next.at") - F.col(at) < F.col(at) - F.col("prev.at")))
    pick = F.when(later, F.col("next")).otherwise(F.col("prev"))
    return near.select(key, at, "lv", pick["at"].alias("near_at"), pick["value"].alias("near_value")).filter("near_at is not null")


def grid(spark, **values: list) -> DataFrame:
    """Every combination of the named values."""
    df = spark.range(1).drop("id")
    for name, options in values.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in options])).alias(name))
    return df


def rounds(jobs: DataFrame, order: str, slots: int = 4) -> DataFrame:
    """``(…, round, slot)`` of jobs taken ``slots`` at a time."""
    return numbered(jobs, order, "_i").withColumns({"round": F.floor(F.col("_i") / slots), "slot": F.pmod("_i", F.lit(slots))}).drop("_i")


def mean_loss(log: DataFrame, epoch: str, loss: str) -> DataFrame:
    """``(epoch, loss)``: mean loss of each epoch; steps without a loss don't count."""
    return log.groupBy(F.col(epoch).alias("epoch")).agg(F.avg(loss).alias("loss"))


def timing(trials: DataFrame, size: str, seconds: str) -> DataFrame:
    """``(size, trials, mean, std, comparisons, ms_each)``: times by number of phrases, with the population's deviation and the
    milliseconds a comparison takes (A28, P30)."""
    n = F.col(size)
    t = trials.groupBy(n.alias("size")).agg(F.count(seconds).alias("trials"), F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("std"))
    return t.withColumn("comparisons", F.col("size") * F.col("size")).withColumn("ms_each", F.try_divide(F.col("mean"), F.col("comparisons")) * 1000)


def outcomes(jobs: DataFrame, group: str, ok: str) -> DataFrame:
    """``(group, done, failed, share)`` of jobs by outcome; an unknown one has failed."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return jobs.groupBy(group).agg(F.count_if(good).alias("done"), F.count_if(~good).alias("failed"), F.avg(good.cast("double")).alias("share"))


def compared(models: DataFrame, score: str, *ties: str) -> DataFrame:
    """Models from the best score down, those without one last."""
    return models.orderBy(F.col(score).desc_nulls_last(), *ties)


def best_run(runs: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The run of each group with the highest score, ties by smaller ``tie``; groups without any score are left out."""
    rest = [c for c in runs.columns if c != group]
    order = F.struct((-F.col(score).cast("double")).alias("s"), F.col(tie).alias("t"))
    return runs.filter(F.col(score).isNotNull()).groupBy(group).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(group, "_r.*")


def evaluated(log: DataFrame, step: str, *needed: str) -> DataFrame:
    """Log rows that have the needed values, by step."""
    for c in needed:
        log = log.filter(F.col(c).isNotNull())
    return log.orderBy(step)


def merged_summaries(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Rows of both summaries by key, each value from the first that has it."""
    names = list(dict.fromkeys([*first.columns, *second.columns]))
    a, b = (df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(n)) for df, n in ((first, "_a"), (second, "_b")))
    have = lambda c: F.coalesce(*[F.col(f"{n}.{c}") for n, df in (("_a", first), ("_b", second)) if c in df.columns])
    return a.join(b, list(keys), "full").select(*keys, *[have(c).alias(c) for c in names if c not in keys])
