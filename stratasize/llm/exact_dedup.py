"""Exact deduplication by skew-safe combining: local groups, salted digest groups, then the salts' winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import SPACE_PATTERN, kept_rows, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest_bits: int = 256) -> DataFrame:
    """For each row of docs, the group of rows with an equal text and the row of it that stays.

    Texts are equal when identical after each run of white space became one space; null counts as empty.
    Returns doc_id, keep_id (the group's smallest doc_id), group_size, kept, text_sha256.

    1. Equal texts of a task and salt combine before anything is shuffled (the map side of the first grouping).
    2. The rows of a (digest, salt, text) combine; a hot text is spread over the salts.
    3. The salts' winners of a (digest, text) combine. Whole texts are grouping keys in all three, so a digest that
       two texts share makes two groups.
    Then rows look up their group by digest; only rows of a digest with several texts look it up by text as well.

    Nulls: a null text is an empty one; a null doc_id loses to any other, and a group without any id keeps null.
    Rows that repeat a doc_id and text count each in group_size and get the same verdict. A very long text is one
    grouping key, held whole.
    Empty table: empty result. Other columns, whatever their names, are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_PATTERN, " ").alias("norm"))
    rows = rows.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), _salt(salts).alias("salt"))
    rows = rows.withColumn("digest", F.substring(F.unhex("text_sha256"), 1, max(1, digest_bits // 8)))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # The digest's partitioning holds here, so this needs no further shuffle.
    per_digest = whole.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = written(per_digest.where("group_size > 1"), "exact-groups")
    spread = groups.where("texts = 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("digest", "salt", "keep_id", "group_size")
    thin = rows.select("doc_id", "text_sha256", "digest", "salt")
    clash = groups.where("texts > 1").select("digest")
    if not clash.isEmpty():  # a digest with several texts: look up by the text itself
        told = whole.join(clash, "digest", "left_semi").select("digest", "norm", "keep_id", "group_size")
        apart = rows.join(clash, "digest", "left_semi").join(told, ["digest", "norm"])
        thin = thin.join(clash, "digest", "left_anti")
        return _verdict(thin.join(spread, ["digest", "salt"], "left")).unionByName(_verdict(apart))
    return _verdict(thin.join(spread, ["digest", "salt"], "left"))


def _salt(salts: int) -> F.Column:
    """By id; rows without one are dealt by their place, since any salt gives the same groups."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(salts)).cast("int")


def _verdict(found: DataFrame) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each text, with all its columns: the one with the group's smallest doc_id, one of them where
    several have it. Rows are told apart by id and text. Rows without an id stay only where no equal text has one."""
    won = exact_dedup(docs, id_col, text_col, **options).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_PATTERN, " ")
    return kept_rows(docs, written(won, "exact-winners"), {"doc_id": F.col(id_col).cast("long"), "text_sha256": F.sha2(text, 256)})
