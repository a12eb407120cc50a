"""Model weights as tables ``(name, row, values)``: size, projections, low-rank merge, saving and loading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.functions.vector import dot
from ontospark.runtime import exists


def parameter_count(weights: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """``(parameters, trainable, bytes)`` of four-byte weights; ``trained (name)`` tells those that training changes, None all."""
    n = F.size("values").cast("long")
    rows = weights.select("name", n.alias("n"))
    rows = rows.withColumn("t", F.lit(True)) if trained is None else rows.join(trained.select("name", F.lit(True).alias("t")).distinct(), "name", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parameters"), F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("trainable"), F.coalesce(F.sum(F.col("n") * 4), F.lit(0)).alias("bytes"))


def lora_merge(base: DataFrame, down: DataFrame, up: DataFrame, alpha: float, rank: int) -> DataFrame:
    """``W + (alpha / rank) * up @ down`` (X11) for matrices ``(name, row, values)``: ``down`` has ``rank`` rows as long as those of W, ``up`` a
    row of ``rank`` values for each of W. Matrices without both parts stay as they are; values are DOUBLE."""
    columns = down.select("name", "row", F.posexplode("values").alias("col", "v")).groupBy("name", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"]).alias("d"))
    turned = columns.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "d"))), lambda x: x["d"]).alias("cols"))
    parts = up.select("name", "row", F.col("values").alias("u")).join(turned, "name")
    both = base.join(parts, ["name", "row"], "left")
    add = F.zip_with(F.col("values").cast("array<double>"), "cols", lambda w, c: w + F.lit(alpha / rank) * dot(F.col("u"), c))
    return both.select("name", "row", F.when(F.col("cols").isNotNull(), add).otherwise(F.col("values").cast("array<double>")).alias("values"))


def projected(vectors: DataFrame, weights: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    """``(key, vec)``: each vector times the matrix ``name`` of a weight table; the matrix is one row of the plan."""
    rows = weights.filter(F.col("name") == name).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.col("values").cast("array<double>").alias("v")))), lambda x: x["v"]).alias("_m"))
    return vectors.join(F.broadcast(rows)).select(key, F.transform("_m", lambda r: dot(F.col(vec), r)).alias(vec))


def save_model(weights: DataFrame, path: str, config: dict) -> None:
    """Weights and their configuration in one folder; the configuration is a JSON row."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    weights.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/weights"), json.loads(spark.read.parquet(f"{path}/config").first().config)


def best_checkpoint(spark: SparkSession, folder: str) -> dict:
    """What a run left about its best model (S16): ``(model, roc_auc, step, threshold)``.

    The best model is the first of ``best_models/best_models.json``; its own path counts if it exists, else the file name beside the list. The
    threshold is looked for in the best model's summary, there in the older place, then in the run's; none gives 0.5."""
    read = lambda p: spark.read.json(p, multiLine=True) if exists(spark, p) else None
    listed = read(f"{folder}/best_models/best_models.json")
    first = listed.select(F.get("best_models", F.lit(0)).alias("m")).first().m if listed is not None else None
    if first is None:
        raise FileNotFoundError(f"no best model in {folder}")
    beside = f"{folder}/best_models/{first.model_filename}"
    model = next((p for p in (first.model_path, beside) if p and exists(spark, p)), None)
    if model is None:
        raise FileNotFoundError(f"neither {first.model_path} nor {beside}")
    threshold = None
    for path, place in (("best_models/best_model_evaluation_summary.json", "best_results.best_thresholds.f1_score.threshold"), ("best_models/best_model_evaluation_summary.json", "best_thresholds.f1"), ("best_results.json", "best_results.best_thresholds.f1_score.threshold")):
        table = read(f"{folder}/{path}")
        if threshold is None and table is not None:
            try:
                threshold = table.select(F.col(place).cast("double")).first()[0]
            except Exception:  # no such field in this file
                continue
    return {"model": model, "roc_auc": first.roc_auc, "step": first.step, "threshold": 0.5 if threshold is None else threshold}
