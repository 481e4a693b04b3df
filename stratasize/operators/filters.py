"""Filters, row identity and scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.sources.sinks import stored


def without_templates(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("is_template", F.lit(False)))


def active(df: DataFrame) -> DataFrame:
    """Powered on, and no template."""
    return df.where(F.coalesce("is_powered_on", F.lit(False)) & ~F.coalesce("is_template", F.lit(False)))


def without_ignored(df: DataFrame, exclude_ignored: bool = True) -> DataFrame:
    return df.where(~F.coalesce("is_ignored", F.lit(False))) if exclude_ignored and "is_ignored" in df.columns else df


def in_scope(df: DataFrame, datacenters: Sequence[str] = (), clusters: Sequence[str] = ()) -> DataFrame:
    """Rows of the datacenters and clusters given; an empty list, or a table without the column, filters nothing.
    The predicates reach the scan, and prune partitions of tables stored by datacenter."""
    for name, wanted in (("datacenter", datacenters), ("cluster", clusters)):
        if wanted and name in df.columns:
            df = df.where(F.col(name).isin(list(wanted)))
    return df


def scope_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't blank, in order."""
    return df.select(X.stripped(F.col(column)).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def scope_preview(df: DataFrame, datacenters: Sequence[str] = (), clusters: Sequence[str] = ()) -> DataFrame:
    """(selected, total) rows."""
    hit = F.lit(True)
    for name, wanted in (("datacenter", datacenters), ("cluster", clusters)):
        if wanted and name in df.columns:
            hit = hit & F.coalesce(F.col(name).isin(list(wanted)), F.lit(False))
    return df.agg(F.count_if(hit).alias("selected"), F.count(F.lit(1)).alias("total"))


def scope_choice(chosen: Sequence[str], offered: Sequence[str]) -> list[str]:
    """A choice of everything is the same as none."""
    return [] if set(chosen) >= set(offered) else sorted(set(chosen))


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the term in any of the columns, in any case."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(term.lower())) if term else df


def where_text(df: DataFrame, column: str, value: str, how: str = "contains") -> DataFrame:
    """Rows whose text compares so with a value, in any case: contains, equals, starts, ends, or their opposites with
    `not_` before them; `blank` and `not_blank` take no value. A null is an empty text. No value: all rows."""
    own, want = F.lower(X.text_or_empty(F.col(column))), value.lower()
    found = {"contains": own.contains(want), "equals": own == want, "starts": own.startswith(want), "ends": own.endswith(want), "blank": own == ""}
    hit = found[how.removeprefix("not_")]
    return df.where(~hit if how.startswith("not_") else hit) if value or how.endswith("blank") else df


def where_number(df: DataFrame, column: str, how: str, value: float, to: float | None = None) -> DataFrame:
    """Rows whose number compares so with a value: =, <>, <, <=, >, >=, or `between` it and `to`, both included. A null
    meets none."""
    own = F.col(column)
    found = {"=": own == value, "<>": own != value, "<": own < value, "<=": own <= value, ">": own > value, ">=": own >= value, "between": own.between(value, value if to is None else to)}
    return df.where(F.coalesce(found[how], F.lit(False)))


def with_confidence(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.where(F.col("classification_confidence").isin(list(levels))) if levels else df


def has_measurements(column: str = "peak_iops") -> Column:
    """Whether any row has measured IOPS (an aggregate)."""
    return F.coalesce(F.bool_or(F.col(column) > 0), F.lit(False))


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = ("source_file",), name: str = "row_index") -> DataFrame:
    """A row number from 0 within each inventory (columns `by`), in the order given; ties by all of a row's text."""
    ties = F.to_json(F.struct(*df.columns))
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*order, ties)) - 1).cast("long"))


#: monotonically_increasing_id() holds a partition's number above so many bits.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df dealt to ranges of an order, sorted and written once, with __place: a range's number above 33 bits, and a row's
    place in it below. Ties by a hash of all of a row's text; equal rows are dealt over ranges."""
    keys = [*order, "__hash", "__deal"]
    keyed = df.withColumns({"__hash": F.xxhash64(F.to_json(F.struct(*df.columns))), "__deal": F.xxhash64(F.monotonically_increasing_id())})
    return stored(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__hash", "__deal").withColumn("__place", F.monotonically_increasing_id()), "ranges")


def numbered_by_ranges(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """A row number from 0 in the order given, nulls first, over the whole table or within each group of the columns `by`;
    ties by a hash of all of a row's text.

    Rows are dealt to range partitions, sorted and written once; a row's number is its place in its partition and the
    rows of the partitions before, of which only the counts reach the driver. A group's numbers start at its first row.
    So no task sees more than a range, whatever a group's size, and equal rows are dealt over ranges as well. The plan
    doesn't grow with the rows.
    """
    laid = in_ranges(df, [*by, *order])
    part, before = F.shiftrightunsigned("__place", _PLACE_BITS), []
    for r in laid.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        before.append((r["p"], before[-1][1] + before[-1][2] if before else 0, r["n"]))
    known = df.sparkSession.createDataFrame(before, "__part long, __before long, __n long").drop("__n")
    number = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    found = laid.join(F.broadcast(known), part == F.col("__part")).withColumn(name, number)  # a row for each partition
    if by:
        first = found.groupBy(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)]).agg(F.min(name).alias("__first"))
        met = F.lit(True)
        for i, c in enumerate(by):
            met = met & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
        found = found.join(first, met).withColumn(name, F.col(name) - F.col("__first")).drop("__first", *[f"__by_{i}" for i in range(len(by))])
    return found.drop("__place", "__part", "__before")


def numbered_globally(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """A row number from 0 over the whole table; see numbered_by_ranges()."""
    return numbered_by_ranges(df, order, (), name)
