"""Rule packs of any size as a table: an index of literals finds the few rules that a row can match."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasize.functions.rules import FALLBACK_PRIORITY, FLAGS, Rule, _any, folded, required_literals
from stratasize.operators.ratios import small

_SIGNALS = ("name", "system", "folder", "description")
#: Fields of a rule that verdicts name.
RULE_FIELDS = ("name", "category", "subcategory", "confidence")
_RULES = [("no", pa.int32()), ("names", pa.string()), ("systems", pa.string()), ("folders", pa.string()), ("whole", pa.bool_()), ("told", pa.bool_()), ("falls_back", pa.bool_())]
_KIND = "array<struct<no:int,names:string,systems:string,folders:string,whole:boolean,told:boolean,falls_back:boolean>>"


def rule_rows(rules: Sequence[Rule]) -> list[tuple]:
    """The rules, in their order, as rows of _RULES: a pattern for each set, null for none."""
    one = lambda patterns: FLAGS + _any(patterns) if patterns else None
    return [(i, one(r.names), one(r.systems), one(r.folders), r.mode == "all", r.description, r.priority >= FALLBACK_PRIORITY) for i, r in enumerate(rules)]


def index_rows(rules: Sequence[Rule]) -> list[tuple[str, str, int]]:
    """(signal, gram, rule_no): a rule can match only if one of its grams is in that signal. A gram has three letters, or
    two where a pattern has no longer literal; a pattern without either has the empty gram, which every row holds."""
    sets = {r: {"name": r.names, "system": r.systems, "folder": r.folders, "description": r.names if r.description else ()} for r in rules}
    known: dict[str, int] = {}
    literals = {(i, s): [required_literals(p) for p in patterns] for i, r in enumerate(rules) for s, patterns in sets[r].items() if patterns}
    for found in literals.values():
        for some in found:
            for x in some or ():
                for g in {x[k : k + 3] for k in range(len(x) - 2)}:
                    known[g] = known.get(g, 0) + 1
    out = set()
    for (i, s), found in literals.items():
        for some in found:
            if some is None or min(map(len, some)) < 2:
                out.add((s, "", i))
                continue
            for x in some:
                # The gram that fewest literals have.
                out.add((s, min((x[k : k + 3] for k in range(len(x) - 2)), key=lambda g: (known[g], g), default=x[:2]), i))
    return sorted(out)


def candidates(rules: Sequence[Rule], texts: Sequence[Column]) -> Column:
    """The rules of _RULES, in their order, of which a gram is in one of a row's folded signals. Arrow batches; a text that
    a batch repeats is looked up once."""
    pack, index = rule_rows(rules), {s: {} for s in _SIGNALS}
    for s, gram, no in index_rows(rules):
        index[s].setdefault(gram, []).append(no)
    always = sorted({no for known in index.values() for no in known.pop("", [])})

    @F.arrow_udf(_KIND)
    def find(name: pa.Array, system: pa.Array, folder: pa.Array, description: pa.Array) -> pa.Array:
        held = []
        for values, s in zip((name, system, folder, description), _SIGNALS, strict=True):
            known, seen = index[s], {}
            for t in (texts_ := values.to_pylist()):
                if t not in seen:
                    grams = {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}
                    seen[t] = [no for g in known.keys() & grams for no in known[g]]
            held.append([seen[t] for t in texts_])
        found = [sorted({*always, *chain(*own)}) for own in zip(*held, strict=True)]
        ends = [0]
        for own in found:
            ends.append(ends[-1] + len(own))
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*pack, strict=True), _RULES, strict=True)], [n for n, _ in _RULES]) if pack else pa.array([], pa.struct(_RULES))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.take(pa.array([*chain(*found)], pa.int32())))

    return find(*texts)


def rule_number_by_index(df: DataFrame, rules: Sequence[Rule], signals: Sequence[Column], name: str = "rule_no") -> DataFrame:
    """df with the number in rules of the first that matches, as classify.rule_number() gives it, for packs of any size.

    Adds __rule_<field> of that rule for each of RULE_FIELDS. signals: name, OS, folder and description, never null. A
    row's grams meet the index, and the patterns of its few candidates are matched in their order up to the first that
    hits. Rows stay where they are, so a task holds no more than an Arrow batch, whatever the table's size, and the plan
    doesn't grow with the rules.
    """
    spark: SparkSession = df.sparkSession
    cols = [f"__{s}" for s in _SIGNALS]
    rows = df.withColumns(dict(zip(cols, signals, strict=True)))
    rows = rows.withColumn("__can", candidates(rules, [folded(F.col(c)) for c in cols]))
    spoken = F.col("__description") != ""

    def hit(x: Column, second: bool) -> Column:
        """Over the sets that have patterns: all of them, or any; a description counts in the second pass only."""
        named = F.regexp_like("__name", x["names"])
        if second:
            named = named | (x["told"] & F.regexp_like("__description", x["names"]))
        sets = [(x["names"], named), (x["systems"], F.regexp_like("__system", x["systems"])), (x["folders"], F.regexp_like("__folder", x["folders"]))]
        some, every, given = F.lit(False), F.lit(True), F.lit(False)
        for pattern, met in sets:
            some, every, given = some | (pattern.isNotNull() & met), every & (pattern.isNull() | met), given | pattern.isNotNull()
        return F.when(x["whole"], given & every).otherwise(some)

    first = lambda met: F.aggregate("__can", F.lit(None).cast("int"), lambda no, x: F.when(no.isNotNull(), no).when(met(x), x["no"]))
    direct = first(lambda x: (~x["falls_back"] | ~spoken) & hit(x, False))
    second = first(lambda x: (x["told"] | x["falls_back"]) & hit(x, True))
    # A generator of one row: the optimiser pushes no filter through it, which would match the patterns once more.
    found = rows.select(*df.columns, F.explode(F.array(F.coalesce(direct, F.when(spoken, second)))).alias(name))
    kinds = "__rule int, " + ", ".join(f"__rule_{f} string" for f in RULE_FIELDS)
    fields = small(spark.createDataFrame([(i, *(getattr(r, f) for f in RULE_FIELDS)) for i, r in enumerate(rules)], kinds))
    return found.join(fields, F.col(name) == F.col("__rule"), "left").drop("__rule")
