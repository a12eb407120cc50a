"""Problem 5: records identical but for spacing, letter case, punctuation or the order of their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.runtime import Stash, dataset_key

#: Parts that a group of copies is dealt into when its ids are looked up.
SALTS = 16


def canonical_text(text: Column) -> Column:
    """Segments (split at ``;``, ``|`` and line breaks) as letters and digits in lower case, empty ones dropped, sorted."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N};|\r\n]+", "")
    return F.array_join(F.array_sort(F.array_remove(F.split(bare, r"[;|\r\n]+"), "")), ";")


def _raw(df: DataFrame, id_col: str, text_col: str, group_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), dataset_key(group_col).alias("grp"))
    return rows.filter(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))


def _survivors(rows: DataFrame) -> DataFrame:
    """Byte-identical rows of a dataset as one, with their number, smallest and largest id; only these are canonicalised."""
    return rows.groupBy("grp", "text").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).withColumn("key", canonical_text(F.col("text")))


def collapsed_records(df: DataFrame, id_col: str = "id", text_col: str = "text_description", group_col: str = "dataset") -> DataFrame:
    """``(dataset, keep_id, copies, variants)``: one row per distinct record, the rows it stands for and its different spellings.

    Null and blank texts and null ids are left out. Texts without any letter or digit are the same (empty) record. Datasets are
    compared trimmed in lower case, null and empty are ``default``. Rows repeated with their id count as copies. Both steps aggregate
    before they shuffle, so a record that holds a third of all rows moves as one row per task.
    """
    found = _survivors(_raw(df, id_col, text_col, group_col)).groupBy("grp", "key").agg(F.min("least").alias("keep_id"), F.sum("n").alias("copies"), F.count("*").alias("variants"))
    return found.select(F.col("grp").alias("dataset"), "keep_id", "copies", "variants")


def copy_links(df: DataFrame, id_col: str = "id", text_col: str = "text_description", group_col: str = "dataset") -> DataFrame:
    """``(keep_id, copy_id)``: the smallest id of each record and each other id of it; cases as in :func:`collapsed_records`."""
    rows = _raw(df, id_col, text_col, group_col)
    raw = Stash(df.sparkSession, "copies").put(_survivors(rows))
    groups = raw.groupBy("grp", "key").agg(F.min("least").alias("keep_id"), F.max("most").alias("last_id")).filter("keep_id <> last_id").select("grp", "key", "keep_id")
    spelt = raw.join(groups, ["grp", "key"]).select("grp", "text", "least", "most", "keep_id")
    single = spelt.filter("least = most").select("keep_id", F.col("least").alias("copy_id"))
    # spellings with several ids are looked up again, each dealt into SALTS parts
    several = spelt.filter("least <> most").select("grp", "text", "keep_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    others = dealt.join(several, ["grp", "text", "salt"]).select("keep_id", F.col("id").alias("copy_id")).distinct()
    return single.unionByName(others).filter("keep_id <> copy_id")
