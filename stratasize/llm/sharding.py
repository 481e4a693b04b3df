"""Contiguous shards of nearly equal bytes: prefix sums over range partitions, cut at equal targets."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.llm.common import free_names, id_or_null_id, shuffle_partitions, written

#: What a document takes beside its text.
OVERHEAD = 16
#: monotonically_increasing_id() holds a partition's number above so many bits, and a row's place in it below.
_PLACE_BITS = 33


def _part(place: str) -> Column:
    return F.shiftrightunsigned(place, _PLACE_BITS)


def _size(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long")


def _cuts(laid: DataFrame, place: str, size: str, totals: list[tuple[int, int, int]], shards: int) -> list[int]:
    """The place of the first row of each shard but the first one (beyond all places for shards after the last row).

    A row belongs to the shard in which the middle of its bytes lies. Only partitions in which a target lies are looked
    at row by row; the totals of the others are enough.
    """
    ends = list(accumulate(b for _, b, _ in totals))
    whole, cuts = ends[-1], []
    at = [bisect_right(ends, whole * s // shards) for s in range(1, shards)]  # the partition in which each target lies
    after = [totals[k + 1][0] << _PLACE_BITS if k + 1 < len(totals) else (totals[-1][0] + 1) << _PLACE_BITS for k in at]
    known = F.create_map(*[F.lit(x) for k in sorted(set(at)) for x in (totals[k][0], ends[k] - totals[k][1])])
    rows = laid.where(_part(place).isin([totals[k][0] for k in set(at)])).select(_part(place).alias("p"), F.col(place).alias("place"), F.col(size).alias("size"))
    end = F.sum("size").over(W.partitionBy("p").orderBy("place")) + known[F.col("p")]
    shard = F.expr(f"least((2 * end - size) * {shards} div {2 * whole}, {shards - 1})")
    first = {r["shard"]: r["place"] for r in rows.withColumn("end", end).select(shard.alias("shard"), "place").groupBy("shard").agg(F.min("place").alias("place")).collect()}
    for s, next_ in zip(range(1, shards), after, strict=True):
        cuts.append(min([next_, *(p for k, p in first.items() if k >= s)]))
    return cuts


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, whole rows, in the order of ids and written so, with size (bytes of the text and 16), shard (from 0) and slot
    (a row's place in its shard, from 0).

    Rows are dealt to range partitions by id, sorted and written once. The partitions' totals give the bytes before each;
    a shard ends where the bytes so far reach its equal share, to the nearest document, so shards differ by a document's
    size. A row's shard follows from its place, so nothing but the written table is read afterwards. The totals (a row
    for a partition) and the cuts (one for a shard) are all that reaches the driver.

    Nulls: a null text has size 16; null ids come first. Rows that share an id are ordered by a hash of their text; equal
    rows are dealt over partitions by their place in the input, since their order tells nothing. A very long text is a
    row like any other, moved whole; shards that it fills alone may leave the next ones empty. Empty table: empty result.
    Other columns pass through, except size, shard and slot, which are replaced.
    """
    if shards < 1:
        raise ValueError("there is one shard at least")
    id_, hash_, deal, place, part, before = free_names(docs, "__id", "__hash", "__deal", "__place", "__part", "__before")
    order = [id_, hash_, deal]
    keyed = docs.withColumns({"size": _size(text_col), id_: id_or_null_id(id_col), hash_: F.xxhash64(text_col), deal: F.xxhash64(F.monotonically_increasing_id())})
    ranges = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    laid = written(ranges.drop(*order).withColumn(place, F.monotonically_increasing_id()), "shard-rows")
    totals = [tuple(r) for r in laid.groupBy(_part(place).alias("p")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()]
    if not totals:
        return laid.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop(place)
    cuts = _cuts(laid, place, "size", totals, shards) if shards > 1 else []
    rows_before = dict(zip([p for p, _, _ in totals], accumulate([0, *(n for _, _, n in totals[:-1])]), strict=True))
    every = sum(n for _, _, n in totals)
    # The number of the first row of each shard over the whole table.
    starts = [0, *(rows_before[c >> _PLACE_BITS] + (c & ((1 << _PLACE_BITS) - 1)) if c >> _PLACE_BITS in rows_before else every for c in cuts)]
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(place))) if cuts else F.lit(0)
    known = docs.sparkSession.createDataFrame([(p, n) for p, n in rows_before.items()], f"`{part}` long, `{before}` long")
    found = laid.withColumn("shard", shard).join(F.broadcast(known), _part(place) == F.col(part))  # a row for each partition
    inside = F.col(place).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    slot = F.col(before) + inside - F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    return found.withColumn("slot", slot).drop(place, part, before)


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The shards as folders shard=<n> of Parquet files, rows in the order of their slots; no shuffle beyond the one by
    ranges, since a shard's rows stand in neighbouring partitions."""
    shard_documents(docs, shards, id_col, text_col).write.partitionBy("shard").parquet(path)
