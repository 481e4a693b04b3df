"""Token ids as Parquet list columns, with an index of documents that is read without them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.llm.common import bounded_batches, shuffle_partitions, slices
from stratasize.llm.tokens import DEFAULT_TOKENIZER, SLICE, encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str = DEFAULT_TOKENIZER,
    end_id: int = 1,
    row_group_bytes: int = 16 << 20,
    page_rows: int = 256,
    page_bytes: int = 256 << 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the ids of each whole text and an end id, in ascending doc_id order over files and rows.

    Ids are dictionary encoded (a vocabulary fits one dictionary page of a row group); doc_id, part, part_start and
    n_tokens are delta encoded. Row groups and pages have the sizes given, and the writer adds page indexes, so a read of
    some documents (read_tokens) or of the index alone (read_index) skips the pages of all other ids.

    Nulls: a null text is empty and has the end id only; null doc_ids come first. Rows that repeat a doc_id are written
    each, in order of their texts' hashes. Empty table: files without rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, 1, SLICE):
                ids, size = words.encode(rows.column(1))
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(size), part, np.int32)), pa.array(at + ends - size), pa.array(size), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"])
                at += int(ends[-1]) if len(ends) else 0

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = ordered.mapInArrow(run, SCHEMA).write.option("compression", "snappy")
    settings = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20,
    }
    for k, v in settings.items():
        out = out.option(k, v)
    out.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) from the files, without reading ids; start counts the ids of all documents before."""
    return _with_start(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids), of all documents or of those from low to high; page indexes skip the others."""
    return _with_start(spark, path, low, high).select("doc_id", "start", "n_tokens", "ids")


def _with_start(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    files = spark.read.schema(SCHEMA).parquet(path)
    # One row for each partition that wrote, so the window and the broadcast are bounded by their number.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    if low is not None:
        files = files.where(F.col("doc_id") >= low)
    if high is not None:
        files = files.where(F.col("doc_id") <= high)
    return files.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start"))


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of each row's ids as little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            ends = np.cumsum(batch.column(2).to_numpy())
            crc = [zlib.crc32(flat[a:b]) for a, b in zip((ends - batch.column(2).to_numpy()).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return bounded_batches(tokens).select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
