"""Merging inventories of the same machines by name, each column with its own priority."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.operators.capacity import joined
from stratasize.sources.columns import CANONICAL, MEASURED
from stratasize.sources.sinks import stored

#: Texts and numbers of the first source count before the second's; these exist in the first one only.
FIRST_ONLY = ("vm_description", "hw_version", "tools_status")
DEFAULTS = {"is_template": False, "is_powered_on": True, "hw_version": 0, "tools_status": ""}


def merge_key(name: Column) -> Column:
    return F.lower(X.stripped(X.text_or_empty(name)))


def merge_sources(first: DataFrame, second: DataFrame, treat_blank_as_null: bool = False) -> DataFrame:
    """A row for each pair of rows with one name (in any case), and for each row without a partner.

    The first source's value counts unless it is null; the second's used space counts if it is positive; measured
    columns come from the second. A blank or zero is a value unless treat_blank_as_null. All canonical columns stay.
    Names that repeat on both sides give all their pairs. A shuffle of each side by name; where a name is hot, write
    it with merge_skewed_sources(), whose joins Spark can split.
    """
    left, right = _side(first, "l", treat_blank_as_null), _side(second, "r", treat_blank_as_null)
    return _merged(left.join(right, left["l_key"] == right["r_key"], "full_outer"))


def merge_skewed_sources(first: DataFrame, second: DataFrame, treat_blank_as_null: bool = False) -> DataFrame:
    """merge_sources() as a left join and the right side's rest: outer joins of one side are split where a name is hot."""
    left, right = _side(first, "l", treat_blank_as_null), _side(second, "r", treat_blank_as_null)
    matched = left.join(right, left["l_key"] == right["r_key"], "left")
    rest = right.join(left.select("l_key").distinct(), right["r_key"] == F.col("l_key"), "left_anti")
    return _merged(matched.unionByName(rest, allowMissingColumns=True))


def _side(df: DataFrame, side: str, blank: bool) -> DataFrame:
    return df.select(merge_key(F.col("vm_name")).alias(f"{side}_key"), *[_cleaned(f.name, f.dataType.simpleString(), blank).alias(f"{side}_{f.name}") for f in CANONICAL if f.name in df.columns])


def _merged(pairs: DataFrame) -> DataFrame:
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}") if f"{side}_{name}" in pairs.columns else F.lit(None)

    def one(name: str) -> Column:
        if name == "source_format":
            return F.lit("merged")
        if name == "vm_name":
            return X.stripped(F.coalesce(col("l", name), col("r", name)))
        if name == "in_use_mib":
            return F.when(col("r", name) > 0, col("r", name)).otherwise(col("l", name))
        if name in MEASURED:
            return col("r", name)
        value = col("l", name) if name in FIRST_ONLY else F.coalesce(col("l", name), col("r", name))
        return F.coalesce(value, F.lit(DEFAULTS[name])) if name in DEFAULTS else value

    return pairs.select(*[one(f.name).cast(f.dataType).alias(f.name) for f in CANONICAL])


def merge_statistics(first: DataFrame, second: DataFrame) -> DataFrame:
    """(total, matched, first_only, second_only): merged rows, and distinct names of both, the first, the second only.

    Rows are counted by name before they meet, so repeated names don't fan out here.
    """
    count = lambda df, name: df.groupBy(merge_key(F.col("vm_name")).alias("k")).agg(F.count(F.lit(1)).alias(name))
    both = count(first, "a").join(count(second, "b"), "k", "full_outer")
    rows = F.coalesce(F.col("a") * F.col("b"), F.col("a"), F.col("b"))
    found = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("total"), found.alias("matched"), F.count_if(F.col("b").isNull()).alias("first_only"), F.count_if(F.col("a").isNull()).alias("second_only")
    )


#: What tells where a row is from; the first source's counts.
ORIGIN = ("source_file", "row_no")


def _ranked(sources: Sequence[DataFrame], by: Sequence[str], blank: bool) -> DataFrame:
    """All rows of the sources under one schema: __rank, __key, `by`, the origin, and the canonical columns."""
    origin = [c for c in ORIGIN if c not in by and any(c in s.columns for s in sources)]

    def one(rank: int, df: DataFrame) -> DataFrame:
        fields = [f for f in CANONICAL if f.name in df.columns]
        cols = [(F.lit(None) if rank and f.name in FIRST_ONLY else _cleaned(f.name, f.dataType.simpleString(), blank)).cast(f.dataType).alias(f.name) for f in fields]
        return df.select(*by, *[c for c in origin if c in df.columns], *cols, merge_key(F.col("vm_name")).alias("__key"), F.lit(rank).alias("__rank"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(i, s) for i, s in enumerate(sources)])


def _cleaned(name: str, kind: str, blank: bool) -> Column:
    c = F.col(name)
    if blank and kind == "string":
        return F.when(X.stripped(c) != "", c)
    return F.when(c != 0, c) if blank and kind in ("int", "double") and name not in MEASURED else c


def fold_sources(sources: Sequence[DataFrame], by: Sequence[str] = (), treat_blank_as_null: bool = False, match_blank: bool = False) -> DataFrame:
    """Any number of sources, the most trusted first, as one table: a row for each machine name in an inventory (columns
    `by`, which all sources have).

    The rules are those of merge_sources(), one source after the other: the first source's value that isn't null counts;
    used space is that of the last source after the first in which it is positive; measured columns come from the last
    source that has them; hardware, tools and descriptions from the first source alone. Two sources, of which the first
    measures nothing, give what merge_sources() gives.

    One grouped aggregation, combined before it travels, whatever the number of sources. Names that a source repeats
    give all pairs of their rows, as a join does; those names alone are joined, source by source. Blank names meet
    nothing unless match_blank: each stays a row of its own. Rows that meet nothing stay. origin columns (source_file,
    row_no) are those of the first source that has the machine.
    """
    rows = stored(_ranked(sources, by, treat_blank_as_null), "ranked-sources")
    ranks = range(len(sources))
    columns = [c for c in rows.columns if c not in (*by, "__key", "__rank")]
    named_ = rows if match_blank else rows.where(F.col("__key") != "")
    known = lambda c: F.col(c).isNotNull()
    first = lambda c: F.min(F.when(known(c), F.struct("__rank", c)))[c].alias(c)
    last = lambda c, hit: F.max(F.when(hit, F.struct("__rank", c)))[c]

    def one(c: str) -> Column:
        if c == "in_use_mib":
            return F.coalesce(last(c, (F.col("__rank") > 0) & (F.col(c) > 0)), last(c, F.col("__rank") == 0)).alias(c)
        return last(c, known(c)).alias(c) if c in MEASURED else first(c)

    most = F.greatest(*[F.count_if(F.col("__rank") == i) for i in ranks], F.lit(0))
    folded = named_.groupBy(*by, "__key").agg(*[one(c) for c in columns], most.alias("__most"))
    folded = stored(folded, "folded-sources")
    once = folded.where("__most = 1").select(*by, *columns)
    repeated = folded.where("__most > 1").select(*by, F.col("__key").alias("__again"))
    parts = [joined(named_, repeated, {"__again": F.col("__key")}, by, "left_semi").where(F.col("__rank") == i).drop("__rank") for i in ranks]
    again = reduce(lambda a, b: _stepped(a, b, by, columns), parts).select(*by, *columns)
    out = once.unionByName(again)
    if not match_blank:
        out = out.unionByName(rows.where(F.col("__key") == "").select(*by, *columns))
    final = {"source_format": F.lit("merged"), "vm_name": X.stripped(F.col("vm_name"))} | {c: F.coalesce(F.col(c) if c in columns else F.lit(None), F.lit(v)) for c, v in DEFAULTS.items()}
    out = out.withColumns(final)
    extra = [c for c in columns if c in ORIGIN]
    return out.select(*by, *[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL], *extra)


def _stepped(done: DataFrame, more: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the sources so far with those of the next one, by all pairs of a name."""
    right = more.select(F.struct(*by, "__key").alias("__k"), F.struct(*columns).alias("__r"))
    both = done.select(F.struct(*by, "__key").alias("__k"), F.struct(*columns).alias("__l")).join(right, "__k", "full_outer")
    old, new = (lambda c: F.col(f"__l.{c}")), (lambda c: F.col(f"__r.{c}"))

    def one(c: str) -> Column:
        if c == "in_use_mib":
            return F.when(new(c) > 0, new(c)).otherwise(old(c))
        return F.coalesce(new(c), old(c)) if c in MEASURED else F.coalesce(old(c), new(c))

    return both.select(*[F.col(f"__k.{c}").alias(c) for c in (*by, "__key")], *[one(c).alias(c) for c in columns])


def fold_statistics(sources: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """(`by`, sources, names): how many distinct names stand in exactly which sources, as a text like `0+2`."""
    rows = reduce(lambda a, b: a.unionByName(b), [s.select(*by, merge_key(F.col("vm_name")).alias("k"), F.lit(i).alias("i")) for i, s in enumerate(sources)])
    sets = rows.groupBy(*by, "k").agg(F.array_join(F.sort_array(F.collect_set("i")), "+").alias("sources"))  # as many values as sources
    return sets.groupBy(*by, "sources").agg(F.count(F.lit(1)).alias("names"))
