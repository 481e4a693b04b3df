"""What the text operators share: tables, written stages, and vectorised word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+, as byte values (fixed values).
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Text that is held at once inside a task, in bytes; one longer document is held alone.
SLICE_BYTES = 4 << 20
#: The id that stands for a null doc_id inside the operators; it sorts before all others.
NULL_ID = -(1 << 63)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE_BYTES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one is set for
    a local master (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after Arrow batches of its session got SLICE_BYTES as their limit, unless a limit other than Spark's default is
    set. A batch of thousands of long texts would otherwise be held several times beside each Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m") in ("67108864b", "64m"):
        conf.set(key, str(SLICE_BYTES))
    return df


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written in the block go to a folder that is deleted after it. Gives a function that writes one to stay."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield lambda df, name: written(df, name, shared_dir(spark))
    finally:
        _scratch.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: later reads survive lost executors and nothing is computed twice."""
    path = f"{folder or _scratch.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label_sample(rows: DataFrame, most: int) -> DataFrame | None:
    """The rows (label, h and more) of each label with the least hashes h, at most so many; None if there are no rows.

    Hashes below a label's share of all pass first, about twice the sample; then rows are numbered, which Spark limits
    in each task before it shuffles, so rows that repeat one hash don't gather.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    space = 1 << 30
    part = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(space, space * 2 * most // n + 1))])
    thin = rows.where(F.pmod("h", F.lit(space)) < part[F.col("label")])
    return thin.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("h"))).where(F.col("nth") <= most).drop("nth")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def kept_rows(docs: DataFrame, won: DataFrame, keys: dict[str, F.Column]) -> DataFrame:
    """The rows of docs whose keys (columns of won by name, as expressions over docs) are in won, one of each: won has n,
    how many rows of docs have its keys. Rows whose keys come once are only looked up; of the others one stays, whichever
    (they are equal in what the keys say), combined in tasks before they travel."""
    names = dict(zip(keys, free_names(docs, *[f"__{k}" for k in keys]), strict=True))
    rows = docs.withColumns({names[k]: v for k, v in keys.items()})
    won = won.select(*[F.col(k).alias(names[k]) for k in keys], F.col("n"))
    on = list(names.values())
    look = lambda some: rows.join(some.select(*on), [rows[c].eqNullSafe(some[c]) for c in on], "left_semi")
    again = won.where("n > 1")
    if again.isEmpty():
        return look(won).drop(*on)
    return look(won.where("n = 1")).unionByName(look(again).dropDuplicates(on)).drop(*on)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_null_id(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def null_id_to_null(col: str) -> F.Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batch in order, in runs whose texts hold at most so many bytes (or a single row)."""
    offsets = _offsets(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    whole = np.frombuffer(texts.buffers()[1] or b"\0" * 8, dtype=kind)
    return whole[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


class Words:
    """The words of some documents, joined by single spaces in one buffer.

    data: bytes of all words, each followed by one space; start, length: of each word in data;
    first: index of each document's first word, and the number of all words at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = _offsets(texts)
        low, high = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        if texts.null_count:  # a null may keep bytes; they don't count
            valid = np.asarray(texts.is_valid())
            ends = np.where(valid, offsets[1:], offsets[:-1]) - low
        else:
            ends = offsets[1:] - low
        begins = offsets[:-1] - low
        if lower:
            raw = _LOWER[raw]
        inside = _IS_WORD[raw]
        if texts.null_count:
            for a, b in zip(ends.tolist(), (offsets[1:] - low).tolist(), strict=True):
                if b > a:
                    inside[a:b] = False
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        if len(before):
            before[0] = False
            before[begins[begins < len(before)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(after):
            after[-1] = False
            cut = begins[(begins > 0) & (begins <= len(after))] - 1
            after[cut] = False
        self.length = np.flatnonzero(inside & ~after) + 1 - starts
        step = self.length + 1
        ends_at = np.cumsum(step)
        self.start = ends_at - step
        self.data = np.full(int(ends_at[-1]) if len(step) else 0, 0x20, dtype=np.uint8)
        mask = np.ones(len(self.data), dtype=bool)
        mask[self.start + self.length] = False
        self.data[mask] = raw[inside]
        self.first = np.append(np.searchsorted(starts, begins), len(starts))

    def end(self, word: np.ndarray) -> np.ndarray:
        return self.start[word] + self.length[word]

    def document(self) -> np.ndarray:
        """The index of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word. Equal words have equal hashes; unequal ones may, so callers compare contents."""
        return word_hashes(self.data, self.start, self.length)


_ODD, _CHUNK = 0x9E3779B97F4A7C15, 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, _CHUNK + 4096))
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start : start + length] modulo 2^64 by prefix sums, a bounded stretch at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(int(np.searchsorted(start, base + _CHUNK)), at + 1)
        last = int(start[to - 1] + length[to - 1])
        some = data[base:last].astype(np.uint64) + np.uint64(1)
        some *= _power(_ODD, len(some))
        sums = np.zeros(len(some) + 1, dtype=np.uint64)
        np.cumsum(some, out=sums[1:])
        a = start[at:to] - base
        out[at:to] = (sums[a + length[at:to]] - sums[a]) * _power(pow(_ODD, -1, 1 << 64), len(some) + 1)[a]
        at = to
    return mixed(out + length.astype(np.uint64))
