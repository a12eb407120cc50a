"""One-vs-rest classifiers over vectors and graph features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.operators import graph
from ontospark.operators.order import numbered
from ontospark.runtime import Stash


def label_positions(rows: DataFrame, labels: str) -> DataFrame:
    """``(label, pos, n)``: the sorted distinct labels of an array column, their positions and numbers of rows."""
    each = rows.select(F.explode(F.array_distinct(labels)).alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return numbered(each, "label")


def indicators(rows: DataFrame, key: str, labels: str) -> DataFrame:
    """``(key, y)``: for each row a 0/1 array over all labels in order; null and unknown labels set nothing (A32). The labels are one row
    of the plan, so they must be few enough for a row, as any indicator must."""
    every = label_positions(rows, labels).agg(F.array_sort(F.collect_list("label")).alias("every"))
    has = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    return rows.join(F.broadcast(every)).select(key, F.transform("every", lambda v: F.coalesce(F.array_contains(has, v), F.lit(False)).cast("int")).alias("y"))


def graph_features(edges: DataFrame, nodes: DataFrame, **rank) -> DataFrame:
    """``(node, degree, clustering, centrality, pagerank)`` of each node; one that is in no edge gets zeros."""
    inside = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    d, c, p = graph.degrees(edges, inside), graph.clustering(edges), graph.pagerank(edges, inside, **rank)
    found = d.join(c, "node", "left").join(p, "node", "left").select("node", F.col("degree").cast("double").alias("degree"), F.coalesce("coefficient", F.lit(0.0)).alias("clustering"), "centrality", F.col("rank").alias("pagerank"))
    return nodes.join(found, "node", "left").fillna(0.0)


def with_graph(vectors: DataFrame, features: DataFrame, key: str, vec: str) -> DataFrame:
    """Vectors with the four graph features behind their own values."""
    f = features.withColumnRenamed("node", key)
    return vectors.join(f, key).select(key, F.concat(F.col(vec).cast("array<double>"), F.array("degree", "clustering", "centrality", "pagerank")).alias(vec))


class OneVsRest:
    """A binary classifier for each label, rows weighted so that both classes weigh alike.

    ``fit`` takes ``(vec, labels)``: rows without a vector are left out, labels are those of at least one row. Labels are iterated on the
    driver, as each is a model of its own; the rows stay distributed and are written once. A label that every row has is a constant.
    """

    def __init__(self, kind: str = "forest", vec: str = "x", labels: str = "labels", trees: int = 200, depth: int = 20, seed: int = 42):
        self.kind, self.vec, self.labels, self.trees, self.depth, self.seed = kind, vec, labels, trees, depth, seed
        self.models: dict[str, object] = {}

    def _model(self):
        common = {"featuresCol": "_v", "labelCol": "_y", "weightCol": "_w"}
        if self.kind == "forest":
            return RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, featureSubsetStrategy="sqrt", **common)
        return LogisticRegression(maxIter=100, **common)

    def fit(self, rows: DataFrame) -> OneVsRest:
        stash = Stash(rows.sparkSession, "classify")
        data = stash.put(rows.filter(F.col(self.vec).isNotNull()).select(F.col(self.vec).cast("array<double>").alias("_x"), F.coalesce(F.col(self.labels), F.array().cast("array<string>")).cast("array<string>").alias("_l")))
        counts = {r.label: r.n for r in label_positions(data, "_l").collect()}
        total = data.count()
        for label, n in sorted(counts.items()):
            if n == total:
                self.models[label] = None
                continue
            y = F.array_contains("_l", F.lit(label)).cast("double")
            weight = F.when(F.col("_y") == 1, total / (2 * n)).otherwise(total / (2 * (total - n)))
            self.models[label] = self._model().fit(data.select(array_to_vector("_x").alias("_v"), y.alias("_y")).withColumn("_w", weight))
        return self

    def probabilities(self, rows: DataFrame, key: str) -> DataFrame:
        """``(key, label, p)`` for each row with a vector and each label."""
        now = rows.filter(F.col(self.vec).isNotNull()).select(key, array_to_vector(F.col(self.vec).cast("array<double>")).alias("_v"))
        parts = []
        for at, (label, model) in enumerate(self.models.items()):
            if model is None:
                now = now.withColumn(f"_p{at}", F.lit(1.0))
            else:
                model.setProbabilityCol("_q").setRawPredictionCol("_r").setPredictionCol("_c")
                now = model.transform(now).withColumn(f"_p{at}", vector_to_array("_q")[1]).drop("_q", "_r", "_c")
            parts.append(F.struct(F.lit(label).alias("label"), F.col(f"_p{at}").alias("p")))
        each = F.explode(F.array(*parts)) if parts else F.explode(F.array().cast("array<struct<label:string,p:double>>"))
        return now.select(key, each.alias("e")).select(key, "e.label", "e.p")
