"""Scalar expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.functions.rules import FLAGS, ROLE_PREFIX
from stratasize.functions.tables import MIB_PER_GIB, MIB_PER_TIB


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column, default: float | None = 0.0) -> Column:
    """A text or number as a double; what is null, no number, or NaN becomes the default."""
    value = stripped(c.cast("string")).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def number_in(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    """number() of a column of df. Doubles and integers are no texts to be read, and give the same without."""
    if df.schema[name].dataType.typeName() not in ("double", "long", "integer", "short", "byte"):
        return number(F.col(name), default)
    value = F.col(name).cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def whole(c: Column) -> Column:
    """number() cut to an integer; 0 beyond an integer's range."""
    value = number(c)
    return F.coalesce(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).try_cast("int"), F.lit(0))


def truth(c: Column, default: bool = False) -> Column:
    """Text or boolean as a boolean: true, 1 and yes in any case; null is the default."""
    return F.when(c.isNull(), F.lit(default)).otherwise(F.lower(stripped(c.cast("string"))).isin("true", "1", "1.0", "yes"))


def powered_on(c: Column) -> Column:
    return F.lower(text_or_empty(c)) == "poweredon"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def mb_per_second(kb_per_second: Column) -> Column:
    return kb_per_second / 1024


def iops_of_8k(kb_per_second: Column) -> Column:
    return kb_per_second / 8


def gib(mib: Column) -> Column:
    return mib / MIB_PER_GIB


def tib(mib: Column) -> Column:
    return mib / MIB_PER_TIB


def home_datastore(path: Column) -> Column:
    """The datastore in `[datastore] folder/file`; empty without one."""
    return F.regexp_extract(path, r"\[(.*?)\]", 1)


def without_company_prefix(name: Column, patterns: Sequence[str]) -> Column:
    """The name less one match of the first pattern that changes it."""
    out = name
    for p in reversed(patterns):
        cut = F.regexp_replace(name, f"{FLAGS}^(.*?)(?:{p})(.*)$", "$1$2") if not p.startswith("^") else F.regexp_replace(name, FLAGS + p, "")
        out = F.when(cut != name, cut).otherwise(out)
    return out


def without_role_prefix(name: Column) -> Column:
    return F.regexp_replace(name, FLAGS + ROLE_PREFIX, "")


def joined_text(*parts: Column) -> Column:
    """The parts that aren't empty, joined by spaces."""
    return stripped(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def workload_label(category: Column, subcategory: Column) -> Column:
    return F.concat_ws(" / ", category, subcategory)


def label_category(label: Column) -> Column:
    return F.split(label, " / ", 2)[0]


def label_subcategory(label: Column, table: Sequence[tuple] = ()) -> Column:
    """What follows the first separator. A bare category takes its first entry in the table, rows of (order, category,
    subcategory, ...), and an empty text without one; without a table it takes null."""
    first: dict[str, str] = {}
    for _, category, subcategory, *_ in table:
        first.setdefault(category, subcategory)
    bare = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), label), F.lit("")) if first else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(F.split(label, " / ", 2), F.lit(2)), bare)


def workload_key(category: Column, subcategory: Column) -> Column:
    return F.concat_ws("/", category, subcategory)


def storage_text(mib: Column) -> Column:
    return F.concat(F.format_number(gib(mib), 1), F.lit(" GiB ("), F.format_number(tib(mib), 2), F.lit(" TiB)"))


def tib_text(mib: Column) -> Column:
    return F.concat(F.format_number(tib(mib), 1), F.lit(" TiB"))


def percent_text(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def file_name(name: Column) -> Column:
    """Runs of other characters than letters and digits as one underscore, none at the ends; `report` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("report")).otherwise(clean)


def scope_suffix(names: Column, most: int = 3, width: int = 20) -> Column:
    """The first names, cut to a width and joined by dashes, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(names, 1, most), lambda x: F.substring(file_name(x), 1, width)), "-")
    more = F.size(names) - most
    return F.when(more > 0, F.concat(shown, F.lit("-and"), more.cast("string"), F.lit("more"))).otherwise(shown)


def pseudonym(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 12)


def safe_cell(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula, with a quote before it."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
