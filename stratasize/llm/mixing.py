"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.llm.common import SPACE_PATTERN, WORD_PATTERN, free_names, written
from stratasize.operators.filters import numbered_by_ranges

#: Weights of the sources in order of name, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: For each weight, its schedule over the training's time from 0 to 1: (time, rate) knots, straight between them.
#: Only the shape counts; a source's integral is scaled to its target.
SCHEDULES = (
    ((0.0, 1.0), (0.6, 1.0), (1.0, 0.4)),
    ((0.0, 0.8), (1.0, 1.2)),
    ((0.0, 0.4), (0.5, 1.0), (1.0, 1.8)),
)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: (source, source_size). Adds kind (index of the weight), weight and target.

    Sources in code point order, null last, take the weights in turn. The whole target is share times all words; each
    source gets its part by weight, at most `most` times its own words, and what is above goes to the others by weight
    until none is above. With r = limit / weight that level is the first of the sources, in order of r, at which
    (whole - limits before) / (weights from here) is no more than r. One row a source, so the windows are small.
    """
    at = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    known = sources.withColumn("kind", F.pmod(at, F.lit(len(weights))).cast("int"))
    known = known.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1))
    known = known.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("limit") / F.col("weight"), "source")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (whole - before) / onward
    known = known.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    level = F.coalesce(F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("limit") / F.col("weight"), "level"))).over(W.partitionBy())["level"], F.lit(float("inf")))
    return known.withColumn("target", F.least(F.col("limit"), level * F.col("weight"))).drop("level", "limit")


def training_time(demand: F.Column, kind: F.Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> F.Column:
    """The time at which a source has used the fraction `demand` (0 to 1) of its target: the inverse of its integrated
    schedule, piece by piece. On a piece from (t0, r0) to (t1, r1) the area a after t0 solves r0 x + s x^2 / 2 = a.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
        whole, done = sum(areas), 0.0
        pieces = []  # (fraction of the target at its end, time)
        for (t0, r0), (t1, r1), area in zip(knots, knots[1:], areas):
            slope, a = (r1 - r0) / (t1 - t0), F.greatest(demand * F.lit(whole) - F.lit(done), F.lit(0.0))
            # 2a / (r0 + sqrt(r0^2 + 2 s a)) holds for slope 0 as well.
            root = F.sqrt(F.greatest(F.lit(r0 * r0) + a * F.lit(2 * slope), F.lit(0.0)))
            done += area
            pieces.append((done / whole, F.lit(t0) + F.when(a > 0, a * 2 / (F.lit(r0) + root)).otherwise(F.lit(0.0))))
        time = pieces[-1][1]
        for end, t in reversed(pieces[:-1]):
            time = F.when(demand <= F.lit(end), t).otherwise(time)
        out = F.when(kind == k, F.least(F.greatest(time, F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = 1.5,
    most: int = 2,
    buckets: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row for each row of docs: doc_id, size (words), source, source_size, target, taken, and first_time, last_time:
    when in the training (0 to 1) its first and last copy come. Rows are range-sorted by first_time, those not taken last.

    A source's documents stand in order of a hash of their id and are taken in passes over that order, until the target
    is used up: at most `most` passes, the document at the end only in part, so a source's taken words are its rounded
    target. The word at place p of that order comes when the source's integrated schedule reaches p / target.

    Places are prefix sums in two steps: by (source, hash bucket), then inside a bucket. Sums of a bucket are combined
    before the shuffle and a hot source spreads over all its buckets, so no task holds a source.

    Nulls: a null text has no words; the null source is a source, the last in order; null doc_ids stand in order of a
    hash of their text. Rows that repeat a doc_id are taken each; equal ones (in id, source and text) stand one after the
    other and are one row in the windows. A very long text is one row, only counted. No words at all: every target is 0.
    Empty table: empty result. Other columns are not read.

    More columns: h, a hash of the text, and copy, which counts equal rows from 0; repeats, how many there are.
    """
    id_, text = F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.coalesce(id_, F.concat(F.lit("text:"), F.hex(F.xxhash64(text_col)))).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), key.alias("key"), F.xxhash64(text_col).alias("h"))
    rows = rows.groupBy("doc_id", "source", "size", "key", "h").agg(F.count(F.lit(1)).alias("repeats"))
    rows = rows.withColumn("bucket", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("int"))
    rows = written(rows, "mix-sizes")
    sums = written(rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("repeats")).alias("n")), "mix-sums")
    # From here on windows run over (source, bucket) sums: a bounded number of rows for each source.
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, float(most))
    places = before.join(targets, before["source"].eqNullSafe(targets["source"])).select(before["source"].alias("s"), F.col("bucket").alias("b"), "before", "source_size", "kind", "target")
    known = rows.join(places, rows["source"].eqNullSafe(F.col("s")) & (rows["bucket"] == F.col("b")))
    inside = W.partitionBy("s", "b").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "h").rowsBetween(W.unboundedPreceding, -1)
    known = known.withColumn("place", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("repeats")).over(inside), F.lit(0)))
    known = known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))).withColumn("place", F.col("place") + F.col("copy") * F.col("size"))
    goal = F.round("target").cast("long")
    taken, last = F.lit(0), F.lit(None).cast("long")
    for nth in range(most):
        start = F.col("place") + F.col("source_size") * nth
        part = F.least(F.greatest(goal - start, F.lit(0)), F.col("size"))
        taken, last = taken + part, F.when(part > 0, start).otherwise(last)
    known = known.withColumn("taken", taken.cast("long")).withColumn("last", last)
    when = lambda place: F.when(F.col("taken") > 0, training_time(place / goal, F.col("kind"), schedules))
    out = known.select("doc_id", "size", "source", "source_size", "target", "taken", when(F.col("place")).alias("first_time"), when(F.col("last")).alias("last_time"), "h", "copy", "repeats", "key")
    return written(out, "mix").orderBy(F.col("first_time").asc_nulls_last(), "key").drop("key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs' rows with their columns, once for each time that they are taken, the last time cut to the
    words that are taken of it, in order of training time. Documents that are not taken are left out.

    Rows are told apart by id, source and text; equal ones are numbered, and each is taken as its number is.
    """
    one, other, hashed, copy, size, taken, first, last, nth, when = free_names(docs, "__id", "__source", "__h", "__copy", "__size", "__taken", "__first", "__last", "__nth", "__time")
    names = {"doc_id": one, "source": other, "h": hashed, "copy": copy, "size": size, "taken": taken, "first_time": first, "last_time": last}
    took = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    took = took.where("taken > 0").select(*[F.col(c).alias(n) for c, n in names.items()], "repeats")
    keys = {one: F.col(id_col).cast("long"), other: F.col(source_col), hashed: F.xxhash64(text_col)}

    def joined(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        """left with right's columns, by the keys."""
        right, met = right.withColumnsRenamed({c: f"{c}_" for c in (*keys, *more)}), F.lit(True)
        for c in (*keys, *more):
            met = met & F.col(c).eqNullSafe(F.col(f"{c}_"))
        return left.join(right, met).drop(*[f"{c}_" for c in (*keys, *more)])

    keyed = docs.withColumns(keys)
    rows = joined(keyed, took.where("repeats = 1").drop(copy, "repeats"))
    again = took.where("repeats > 1").drop("repeats")
    if not again.isEmpty():
        numbered = numbered_by_ranges(joined(keyed, again.select(*keys).distinct()), [], list(keys), copy)
        rows = rows.unionByName(joined(numbered, again, copy).drop(copy))
    rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(0), ((F.col(taken) - 1) / F.greatest(size, F.lit(1))).cast("int"))))
    left = F.col(taken) - F.col(nth) * F.col(size)
    text = F.regexp_replace(F.regexp_replace(text_col, SPACE_PATTERN, " "), "^ ", "")
    cut = F.when(left >= F.col(size), F.col(text_col)).otherwise(F.call_function("substring_index", text, F.lit(" "), left.cast("int")))
    time = F.when(F.col(nth) == 0, F.col(first)).otherwise(F.col(last))
    return rows.withColumn(text_col, cut).withColumn(when, time).orderBy(when, id_col, nth).select(*[F.col(f"`{c}`") for c in docs.columns])
