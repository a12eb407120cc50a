"""Readers and writers of the file formats that the pipeline exchanges.

Readers see any storage the session reads. Writers of a single file are for bounded results: more rows than they state fail, and the table
forms (``write_json``, ``write_bundle``) take any number.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.operators.order import numbered
from ontospark.runtime import exists, listing
from ontospark.runtime import hadoop as hadoop_path

# fixed values: the schemas of the exchanged files
TERMS = "id string, term string, types string, RAG array<struct<term:string,types:array<string>,similarity:double>>"
ENTITIES = "id long, text_description string, embedding array<float>, dataset string"
RELATIONS = "ID string, parent string, child string"


def as_list(raw: str):
    """A JSON value that may be a list or a single string, as a list."""
    c = F.col(raw)
    return F.when(c.isNull(), None).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TERMS).json(path, multiLine=True).withColumn("types", as_list("types"))


# fixed values: where a domain's files lie
DOMAIN_FILES = {
    "terms": "{domain}/train/term_typing_train_data.json", "test_terms": "{domain}/test/{lower}_term_typing_test_data.json",
    "pairs": "{domain}/train/{lower}_train_pairs.json", "types": "{domain}/train/{lower}_train_types.txt", "test_types": "{domain}/test/{lower}_test_types.txt",
}


def domain_path(base: str, domain: str, kind: str = "terms") -> str:
    """Path of a domain's file: a known kind or a template with ``{domain}`` and ``{lower}`` (S3)."""
    return f"{base}/{DOMAIN_FILES.get(kind, kind).format(domain=domain, lower=domain.lower())}"


def read_domains(spark: SparkSession, base: str, domains: list[str], name: str = "{domain}/train/{lower}_train.json") -> DataFrame | None:
    """Terms of every domain whose file exists, with the domain as a column; a term without an id gets its position in the domain.
    No file gives None."""
    out = None
    for d in domains:
        path = domain_path(base, d, name)
        if exists(spark, path):
            part = read_terms(spark, path).withColumn("_at", F.monotonically_increasing_id())
            part = numbered(part, "_at", "_pos").withColumn("id", F.coalesce("id", F.col("_pos").cast("string"))).drop("_at", "_pos").withColumn("domain", F.lit(d))
            out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct trimmed lines that are not blank."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("term")).filter("term <> ''").distinct()


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities with a default dataset; a row without an id, a text or an embedding fails the query."""
    df = spark.read.schema(ENTITIES).json(path, multiLine=True)
    need = F.col("id").isNotNull() & F.col("text_description").isNotNull() & F.col("embedding").isNotNull()
    return df.withColumn("id", F.when(need, F.col("id")).otherwise(F.raise_error(F.lit("entity without id, text_description or embedding")).cast("long"))).withColumn("dataset", F.coalesce("dataset", F.lit("default")))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """``(ID, parent, child, parent_id, child_id)`` from either form: objects with texts, or pairs of ids.

    The file is read in pieces that end with a brace (objects) and with a bracket (pairs), so that one of any size is many rows. Texts with a
    closing brace in them aren't supported."""
    raw = spark.read.option("lineSep", "}").text(path)  # objects end with a brace
    objects = raw.select(F.regexp_extract("value", r"(?s)(\{.*)$", 1).alias("r")).filter("r <> ''").select(F.from_json(F.concat("r", F.lit("}")), RELATIONS).alias("o"))
    pairs = spark.read.option("lineSep", "]").text(path).select(F.regexp_extract("value", r"\[\s*(\d+\s*,\s*\d+)\s*$", 1).alias("r")).filter("r <> ''").select(F.from_json(F.concat(F.lit("["), "r", F.lit("]")), "array<long>").alias("p"))
    none = F.lit(None)
    return objects.select("o.ID", "o.parent", "o.child", none.cast("long").alias("parent_id"), none.cast("long").alias("child_id")).unionByName(
        pairs.select(none.cast("string").alias("ID"), none.cast("string").alias("parent"), none.cast("string").alias("child"), F.col("p")[0].alias("parent_id"), F.col("p")[1].alias("child_id")))


def read_few_shot(spark: SparkSession, path: str) -> DataFrame:
    """Examples from a list or a single object; a missing file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "term string, types array<string>")
    return spark.read.schema("term string, types string").json(path, multiLine=True).select("term", as_list("types").alias("types"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(i, j, score)`` from ``.npy`` files; each file is read by one task."""

    def cells(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                m = np.load(io.BytesIO(content))
                for start in range(0, len(m), 1024):
                    part = m[start : start + 1024]
                    i, j = np.indices(part.shape)
                    yield pd.DataFrame({"i": i.ravel() + start, "j": j.ravel(), "score": part.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "i long, j long, score double")


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """``(term, other, score)`` from a CSV whose first column and header are terms."""
    df = spark.read.csv(path, header=True)
    first, rest = df.columns[0], df.columns[1:]
    return df.unpivot([F.col(f"`{first}`").alias("term")], [f"`{c}`" for c in rest], "other", "score").withColumn("score", F.col("score").cast("double"))


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    from ontospark.functions.prompts import step_of

    return spark.read.json(pattern, multiLine=True).withColumn("step", step_of(F.input_file_name()))


def list_runs(spark: SparkSession, base: str, like: str | None = None, limit: int | None = None) -> DataFrame:
    """Run folders, without hidden ones and grid searches, by name."""
    names = [[n] for n, folder in listing(spark, base) if folder and not n.startswith((".", "grid_search_"))]
    df = spark.createDataFrame(names, "run string").orderBy("run")
    df = df.filter(F.col("run").rlike(like)) if like else df
    return df.limit(limit) if limit else df


def first_file(spark: SparkSession, base: str, prefix: str = "", suffix: str = "") -> str | None:
    """The first entry of a folder, by name, that begins and ends so; None where there is none."""
    return next((f"{base}/{n}" for n, _ in listing(spark, base) if n.startswith(prefix) and n.endswith(suffix)), None)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """The table of runs, with types from its values."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_examples(spark: SparkSession, examples: list[dict]) -> DataFrame:
    """``(example, phrases_1, phrases_2, labels)`` from examples in memory."""
    rows = [(i, e["phrases_1"], e["phrases_2"], [[float(v) for v in r] for r in e["labels"]]) for i, e in enumerate(examples)]
    return spark.createDataFrame(rows, "example long, phrases_1 array<string>, phrases_2 array<string>, labels array<array<double>>")


def training_texts(terms: DataFrame, shots=None, most: int | None = None) -> DataFrame:
    """``(text)``: a whole training text for each of ``terms (term, types, reasoning[, RAG])``, retrieved examples before fixed ones."""
    from ontospark.functions import prompts

    none = F.lit(None).cast("array<struct<term:string,types:array<string>>>")
    fixed = none if shots is None else shots
    near = F.transform("RAG", lambda e: F.struct(e["term"].alias("term"), e["types"].alias("types"))) if "RAG" in terms.columns else none
    reasoning = F.col("reasoning") if "reasoning" in terms.columns else F.lit("")
    return terms.select(prompts.training_text(F.col("term"), F.col("types"), reasoning, prompts.choose_examples(near, fixed), most).alias("text"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; ``mode="ignore"`` leaves a result that is there."""
    df.write.mode(mode).json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes over a table that ``df`` may itself read: beside it first, then in its place (K2). A failure before the change leaves the old
    table as it was."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    (new, fs), (old, _) = hadoop_path(spark, beside), hadoop_path(spark, path)
    fs.delete(old, True)
    fs.rename(new, old)


def _bounded(df: DataFrame, most: int, instead: str) -> list[str]:
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use {instead}")
    return rows


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array, for results of at most ``most`` rows; more fail (K1)."""
    Path(path).write_text("[" + ",\n".join(_bounded(df, most, "write_json")) + "]", encoding="utf-8")


def wide(scores: DataFrame, row: str, column: str, score: str, most: int = 10_000) -> DataFrame:
    """A score table with a column for each ``column`` value, by name; more than ``most`` of them fail (K3)."""
    names = [r[0] for r in scores.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns: keep the long form")
    return scores.groupBy(row).pivot(column, names).agg(F.first(score))


def write_wide(scores: DataFrame, path: str, row: str = "term", column: str = "other", score: str = "score") -> None:
    wide(scores, row, column, score).orderBy(row).write.mode("overwrite").csv(path, header=True)


def matrix_blocks(scores: DataFrame, columns: int, rows: int = 1024) -> DataFrame:
    """``(first, content)``: blocks of a matrix of ``(i, j, score)`` as ``.npy`` bytes, ``rows`` rows of ``columns`` values each; absent
    scores are 0 (K4). A block is one task's."""

    def run(t):
        import pyarrow as pa

        i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "score"))
        first = int(i.min() // rows * rows)
        m = np.zeros((min(rows, int(i.max()) - first + 1), columns), np.float32)
        m[i - first, j] = v
        out = io.BytesIO()
        np.save(out, m)
        return pa.table({"first": [first], "content": [out.getvalue()]})

    return scores.select("i", "j", "score").groupBy(F.floor(F.col("i") / rows)).applyInArrow(run, "first long, content binary")


def write_matrix(scores: DataFrame, path: str, shape: tuple[int, int], most: int = 50_000_000) -> None:
    """One ``.npy`` file, for matrices of at most ``most`` cells; for more keep :func:`matrix_blocks` (K4)."""
    if shape[0] * shape[1] > most:
        raise ValueError(f"more than {most} cells: use matrix_blocks")
    m = np.zeros(shape, np.float32)
    for r in matrix_blocks(scores, shape[1]).toLocalIterator():
        part = np.load(io.BytesIO(r.content))
        m[r.first : r.first + len(part)] = part
    np.save(path, m)


def write_relations(pairs: DataFrame, path: str, meta: dict | None = None) -> None:
    """``REL_`` + 8 hex digits of the pair, parent, child; a path without a suffix is a folder."""
    target = Path(path) if Path(path).suffix else Path(path) / "relationships.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    write_json_array(with_relation_ids(pairs), str(target))
    if meta is not None:
        target.with_suffix(".meta.json").write_text(json.dumps(meta))


def with_relation_ids(pairs: DataFrame) -> DataFrame:
    key = F.substring(F.md5(F.concat("child", F.lit("|"), "parent")), 1, 8)
    return pairs.select(F.concat(F.lit("REL_"), key).alias("ID"), "parent", "child")


def write_bundle(path: str, mode: str = "overwrite", metadata: DataFrame | None = None, **tables: DataFrame) -> None:
    """A result of several tables in one folder, with a row of metadata (K6)."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    if metadata is not None:
        metadata.coalesce(1).write.mode(mode).parquet(f"{path}/metadata")


def result_metadata(scores: DataFrame, pairs: DataFrame, threshold: float, **model) -> DataFrame:
    """One row on a result: numbers of terms and pairs, threshold, the scores' figures and what is stated of the model."""
    s = F.col("score")
    stats = scores.agg(F.count_distinct("i").alias("n_terms"), F.struct(F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std")).alias("matrix_stats"))
    n = pairs.agg(F.count("*").alias("n_pairs"))
    return stats.join(F.broadcast(n)).select("n_terms", "n_pairs", F.lit(float(threshold)).alias("threshold_used"), "matrix_stats", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in model.items()] or [F.lit(None).cast("string").alias("model")])).alias("model_info"))


def read_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named tables of a bundle, or all that it holds; a missing one fails."""
    found = names or tuple(n for n, folder in listing(spark, path) if folder)
    return {n: spark.read.parquet(f"{path}/{n}") for n in found}


def edge_lines(pairs: DataFrame, how: str = "tsv") -> DataFrame:
    """``(line)``: edges as csv, tsv, dot or graphml lines (K7)."""
    return pairs.select(_line(how).alias("line"))


def _line(how: str):
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return {
        "csv": F.to_csv(F.struct("child", "parent")),
        "tsv": F.concat_ws("\t", "child", "parent"),
        "dot": F.concat(q("child"), F.lit(" -> "), q("parent"), F.lit(";")),
        "graphml": F.concat(F.lit('<edge source="'), _xml("child"), F.lit('" target="'), _xml("parent"), F.lit('"/>')),
    }[how]


def _xml(column: str):
    text = F.col(column)
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


_AROUND = {
    "dot": ("digraph {", "}"),
    "graphml": ('<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "</graph></graphml>"),
    "csv": ("child,parent", None), "tsv": ("child\tparent", None),
}


def document_lines(pairs: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """``(part, line)``: a whole dot, graphml, csv or tsv document; parts in the order 0 head, 1 nodes, 2 edges, 3 end (K7). Nodes are the
    ``terms (node)``, so that those in no edge are named too."""
    spark, (head, end) = pairs.sparkSession, _AROUND[how]
    node = {"dot": F.concat(F.lit('"'), F.replace(F.replace(F.col("node"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('";')), "graphml": F.concat(F.lit('<node id="'), _xml("node"), F.lit('"/>'))}.get(how)
    lines = spark.createDataFrame([(0, head)] + ([(3, end)] if end else []), "part int, line string")
    if node is not None:
        lines = lines.unionByName(terms.select(F.lit(1).alias("part"), node.alias("line")))
    return lines.unionByName(pairs.select(F.lit(2).alias("part"), _line(how).alias("line")))


def write_document(pairs: DataFrame, terms: DataFrame, how: str, path: str) -> None:
    """The document as text files in one folder whose names follow its order."""
    document_lines(pairs, terms, how).repartitionByRange("part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)


def adjacency_lines(pairs: DataFrame, terms: DataFrame, most: int = 20_000) -> DataFrame:
    """``(node, line)``: a row of 0 and 1 for each of ``terms (node)``, a place for each term in order, 1 where the row's is child of it
    (K7, G8); more than ``most`` terms fail, as a line has one place for each."""
    n = terms.distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} terms: keep the edge list")
    places = numbered(terms.distinct(), "node", "at")
    named = pairs.select(F.col("child").alias("node"), F.col("parent").alias("_p")).distinct().join(places.select(F.col("node").alias("_p"), "at"), "_p")
    ones = places.select("node").join(named.groupBy("node").agg(F.collect_set("at").alias("ones")), "node", "left")
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.array_contains("ones", k.cast("long")), "1").otherwise("0"))
    return ones.select("node", F.array_join(cells, ",").alias("line"))


def zip_json(df: DataFrame, path: str, name: str = "relations.json", most: int = 1_000_000) -> None:
    """One zipped JSON array, for results of at most ``most`` rows; more fail (K8)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "[" + ",".join(_bounded(df, most, "write_json with compression")) + "]")


def markdown_report(stats: DataFrame, title: str, most: int = 10_000) -> str:
    """A table (one row per statistic) as Markdown; more than ``most`` rows fail (K9)."""
    rows = stats.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: a report is for readers")
    head = "| " + " | ".join(stats.columns) + " |\n|" + "---|" * len(stats.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows) + "\n"


def metrics_report(found: DataFrame, domain: str) -> DataFrame:
    """``(line)``: methods ``(method, metric, value)`` compared in a domain, three decimals each, methods and metrics by name."""
    each = found.groupBy("method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", "value"))), lambda m: F.format_string("%s: %.3f", m["metric"], m["value"])), "\n").alias("m"))
    lines = F.concat(F.upper("method"), F.lit(":\n"), F.col("m"))
    return each.agg(F.concat(F.lit(f"Method comparison for domain {domain}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", lines.alias("l")))), lambda x: x["l"]), "\n\n")).alias("line"))


def metrics_json(row: DataFrame, **more) -> DataFrame:
    """``(json)``: each row as one JSON object, with further stated fields."""
    return row.select(F.to_json(F.struct(*row.columns, *[F.lit(v).alias(k) for k, v in more.items()])).alias("json"))


def reuse(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made by ``make()`` and written only if it isn't there."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)
