"""Whole runs over stored results (X14, X13, S11, K6, K12, K15): score terms, keep the result as a bundle, cut it anew, report on it.

A bundle is a folder of tables: ``terms (id, text)``, ``scores (i, j, score)``, ``pairs (child_id, parent_id, confidence, child, parent)`` and
one row of ``metadata``. Scores are kept down to a floor, as all of them are as many as the terms squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.operators import graph, models, similarity
from ontospark.runtime import exists
from ontospark.sources import files


def run_inference(terms: DataFrame, load: Callable[[], models.Encoder], path: str, threshold: float | None = None, stored: float | None = None, floor: float = 0.0, heads: int = 2, key_block: int | None = None, again: bool = False, **model) -> dict[str, DataFrame]:
    """Encodes ``terms (id, text)`` once, scores all pairs by the query/key head and writes the bundle; one that is there is read unless
    ``again``. The threshold is the one given, else the stored one, else 0.5; ``floor``, the lowest score that is kept, bounds later ones."""
    spark = terms.sparkSession
    if again or not exists(spark, f"{path}/metadata"):
        cut = threshold if threshold is not None else stored if stored is not None else 0.5
        named = terms.filter("text is not null").select("id", "text")
        vectors = named.select("id", models.encode(F.col("text"), load).alias("v"))
        files.write_bundle(path, terms=named, scores=similarity.attention(vectors, "id", "v", heads, key_block, above=floor))
        scores = spark.read.parquet(f"{path}/scores")
        files.write_bundle(path, pairs=models.extract_relationships(scores, cut, names=named))
        pairs = spark.read.parquet(f"{path}/pairs")
        files.write_bundle(path, metadata=files.result_metadata(scores, pairs, cut, **model).withColumn("floor", F.lit(float(floor))))
    return files.read_bundle(spark, path)


def cut_anew(spark: SparkSession, path: str, threshold: float, out: str) -> dict[str, DataFrame]:
    """Another threshold over a bundle's scores, written as a bundle that reads the old one's scores instead of holding its own; also the
    pairs gained and lost as ``changes``. A threshold under the scores' floor fails, as pairs would be missing."""
    old = files.read_bundle(spark, path, "terms", "scores", "metadata")
    was = old["metadata"].first()
    if threshold < was["floor"]:
        raise ValueError(f"scores are kept from {was['floor']} on")
    pairs = models.extract_relationships(old["scores"], threshold, names=old["terms"])
    files.write_bundle(out, pairs=pairs, changes=models.changed_pairs(old["scores"], was["threshold_used"], threshold))
    n = spark.read.parquet(f"{out}/pairs").agg(F.count("*").alias("n_pairs"))
    figures = models.threshold_rerun(old["scores"], was["threshold_used"], threshold).join(F.broadcast(n))
    files.write_bundle(out, metadata=figures.withColumn("scores_at", F.lit(f"{path}/scores")))
    return files.read_bundle(spark, out)


def analyze_results(spark: SparkSession, path: str, most: int = 10) -> dict[str, DataFrame]:
    """``structure`` and ``confidence`` rows, the ``most`` terms with the most children and parents as ``degrees``, and short ``cycles``, of a
    bundle's pairs. A child may have several parents here, so depth is that of its surest one's tree and cycles have up to three nodes."""
    bundle = files.read_bundle(spark, path, "terms", "pairs")
    links = bundle["pairs"].select("child", "parent").distinct()
    surest = bundle["pairs"].groupBy("child").agg(F.min_by("parent", F.struct(-F.col("confidence"), F.col("parent_id"))).alias("parent"))
    nodes = bundle["terms"].select(F.col("text").alias("node")).distinct()
    structure = graph.structure_report(links, nodes, surest)
    return {
        "structure": structure, "confidence": models.confidence_stats(bundle["pairs"]),
        "degrees": graph.degree_counts(links).orderBy(F.desc("children"), F.desc("parents"), "term").limit(most), "cycles": graph.short_cycles(links),
    }


def report(spark: SparkSession, path: str, title: str) -> str:
    """The analysis as Markdown (K9)."""
    found = analyze_results(spark, path)
    return "\n".join(files.markdown_report(found[name], f"{title}: {name}") for name in ("structure", "confidence", "degrees", "cycles"))
