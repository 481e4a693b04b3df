"""Rule packs as tables, and thresholds over all scores."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratasize.functions.rules import Rule, default_rules, folded, required_literals
from stratasize.operators import classify as E
from stratasize.operators import rule_index as I
from stratasize.plans import fixtures as fx


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [("SQL", {"sql"}), ("^FS[-_]", {"fs"}), ("(?=.*(?:MSSQL|SQL))(?=.*TDE)", {"tde"}), ("windows 10|windows 11", {"windows 1"}), ("linux|ubuntu", {"linux", "ubuntu"}), (".*", None), (r"LOG(?:\d|[-_.]|$)", {"log"}), ("ab?c|x", {"x", "a"}), ("a|.", None), ("(?:ab)+cdef*", {"cde"}), ("(", None), ("[a]bcd", {"abcd"}), ("xyz|q[0-9]rst", {"rst", "xyz"})],
)
def test_required_literals(pattern, literals):
    found = required_literals(pattern)
    assert found == literals or pattern.startswith("(?=") and found in ({"tde"}, {"mssql", "sql"}) or pattern == "ab?c|x" and found in ({"a", "x"}, {"c", "x"})


def test_literals_before_patterns_change_nothing(spark):
    """Every rule over texts made of pieces of its own patterns, in odd letters too, with and without the search for literals."""
    rng, rules = random.Random(3), default_rules()
    pieces = sorted({x for r in rules for p in (*r.names, *r.systems, *r.folders) for x in re.findall(r"[\w/ -]+", p)}) + ["ſql", "elaſtic", "\u212a8S-enc", "cıtrix", "CİTRİX", "É", "ß", "7", "_"]
    rows = [(i, *["".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in range(4)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, name string, system string, folder string, description string")
    df = df.withColumns({f"{c}_low": folded(F.col(c)) for c in df.columns[1:]})
    signals, low = [F.col(c) for c in df.columns[1:5]], [F.col(c) for c in df.columns[5:]]
    both = [(r.matches(*signals), r.matches(*signals, low)) for r in rules]
    counts = df.agg(*[F.count_if(a) for a, _ in both], *[F.count_if(a != b) for a, b in both]).first()
    assert sum(x > 0 for x in counts[: len(rules)]) > 50 and not any(counts[len(rules) :])


def test_index_equals_the_case(spark, small):
    rows = fx.described(spark, small)
    odd = spark.createDataFrame([(-1, "ſql-srv 1", "", "", ""), (-2, "", "", "", "vcenter server appliance"), (-3, "x", "WINDOWS Server", "", "Nessus"), (-4, "É", "", "/vm/SAP", "y")], "row_index long, vm_name string, os_name string, vm_folder string, vm_description string")
    rows = rows.select(odd.columns).unionByName(odd)
    for rules in (default_rules(), [r for r in default_rules() if r.priority < 900][::-1]):
        case, index = E.rule_number(rows, rules), I.rule_number_by_index(rows, rules, E._signals(rows, ()))
        told = lambda df: {(r["row_index"], r["rule_no"]) for r in df.collect()}
        assert told(case) == told(index)


def test_five_thousand_rules(spark):
    """Verdicts of a plain pass over all rules; the plan is no larger than for a few."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 6)))
    rules = []
    for i in range(5000):
        names = tuple(rng.choice([word(), f"^{word()}", f"{word()}|{word()}x", f"{word()}[0-9]+", "^z."]) for _ in range(rng.randrange(3)))
        systems = (word(),) if not names or rng.random() < 0.3 else ()
        rules.append(Rule(f"r{i}", f"c{i % 9}", f"s{i}", rng.choice([10, 20, 950]), names, systems, (), rng.choice(["any", "all"]), rng.random() < 0.2))
    rules.sort(key=lambda r: r.priority)
    rows = [(i, f"{word()}-{word()}{rng.choice(['', '7'])}", word(), "", rng.choice(["", word() + word()])) for i in range(80)]
    df = spark.createDataFrame(rows, "row_index long, vm_name string, os_name string, vm_folder string, vm_description string")

    def hit(r, name, system, text=None):
        sets = []
        if r.names:
            sets.append(any(re.search(p, name, re.I) or (r.description and text and re.search(p, text, re.I)) for p in r.names))
        if r.systems:
            sets.append(any(re.search(p, system, re.I) for p in r.systems))
        return bool(sets) and (all(sets) if r.mode == "all" else any(sets))

    want = {}
    for i, name, system, _, text in rows:
        direct = next((r for r in rules if (r.priority < 900 or not text) and hit(r, name, system)), None)
        want[i] = direct or (next((r for r in rules if (r.description or r.priority >= 900) and hit(r, name, system, text)), None) if text else None)
    found = E.classify_by_registry(df, rules)
    assert {r["row_index"]: (r["classification_rule"], r["workload_category"], r["classification_confidence"]) for r in found.collect()} == {i: (r.name, r.category, r.confidence) if r else ("default", "Unknown (Reducible)", "default") for i, r in want.items()}
    assert found.columns == [*df.columns, "workload_category", "workload_subcategory", "classification_rule", "classification_confidence"]
    sizes = [len(E.classify_by_registry(df, rules[:n])._jdf.queryExecution().optimizedPlan().toString()) for n in (1000, 5000)]
    assert abs(sizes[0] - sizes[1]) < 0.05 * sizes[0]


def test_thresholds_over_all_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["a", "b"]), rng.choice([None, round(rng.random(), 2)])) for _ in range(700)] + [("a", "a", 0.5)] * 300
    scored = spark.createDataFrame(rows, "route string, label string, score double").repartition(5)
    want = {}
    for route in ("a", "b", None):
        own = [r for r in rows if r[0] == route]
        for t in {s for _, _, s in own if s is not None}:
            accepted = [r for r in own if r[2] is not None and r[2] >= t]
            want[route, t] = (len(own), len(accepted), sum(r[0] == r[1] for r in accepted))
    assert {(r["route"], r["threshold"]): (r["rows"], r["accepted"], r["right"]) for r in E.sweep_thresholds(scored).collect()} == want
    best = {r: max((h / a, a / n, t) for (route, t), (n, a, h) in want.items() if route == r) for r in ("a", "b", None)}
    assert {r["route"]: (r["accuracy"], r["coverage"], r["threshold"]) for r in E.fit_thresholds(scored).collect()} == best
    assert E.fit_thresholds(scored, [0.5]).where(F.col("threshold") != 0.5).isEmpty()


def clustered(rng, n, centres, spread=0.05, kinds=12):
    """Unit vectors near a few centres."""
    at = rng.integers(0, len(centres), n)
    v = centres[at] + spread * rng.standard_normal((n, centres.shape[1]))
    return [(f"r{a % kinds}", "c", "s", x.tolist()) for a, x in zip(at, v)]


def test_pruned_routes_equal_all_products(spark, monkeypatch):
    """Equal to the matrix form on clustered names, with less than a tenth of the products."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24))
    known = spark.createDataFrame([*clustered(rng, 3000, centres), ("zero", "c", "s", [0.0] * 24), ("short", "c", "s", [1.0, 2.0]), ("null", "c", "s", None), ("hole", "c", "s", [1.0, None])], "route string, category string, subcategory string, vector array<double>").repartition(3)
    rows = spark.createDataFrame([(i, v) for i, (*_, v) in enumerate(clustered(rng, 800, centres))] + [(900, [0.0] * 24), (901, None), (902, [2.0, 4.0]), (903, [1.0] * 3), (904, [None] * 24)], "row_index long, vector array<double>")
    monkeypatch.setattr(E, "BLOCK_ROWS", 50)
    told = lambda bound: sorted((r["row_index"], r["route"], round(r["score"], 9)) for r in E.best_routes(rows, known, bound=bound).collect())
    assert told(100) == told(100_000) and len(told(100)) == 801
    e = known.where("size(vector) = 24 AND route <> 'zero'").select("route", E._unit("vector").alias("e"))
    own = rows.where("size(vector) = 24 AND row_index < 900").select(F.col("row_index").alias("k"), E._unit("vector").alias("v"))
    blocked, given = E.candidate_blocks(own, e, block_exemplars=50)
    sizes = blocked.groupBy("block").count()
    first = given(own.withColumn("floor", F.lit(None).cast("double")))
    best = first.join(blocked, "block").groupBy("k").agg(F.max(E.cosine(F.col("v"), F.col("e"))).alias("floor"))
    products = sum(x.join(sizes, "block").agg(F.sum("count")).first()[0] for x in (first, given(own.join(best, "k"))))
    assert products < 0.1 * 800 * 3000


def test_names_are_learned_within_an_inventory(spark, monkeypatch):
    """What one inventory's rules taught doesn't name another's machines; given exemplars count in all."""
    rng = np.random.default_rng(4)
    known = [(None, "base", "c", "s", rng.standard_normal(6).tolist()) for _ in range(5)] + [(f"i{k % 3}", f"l{k % 7}", "c", "s", rng.standard_normal(6).tolist()) for k in range(400)]
    rows = [(f"i{k % 4}" if k % 5 else None, k, rng.standard_normal(6).tolist()) for k in range(300)]
    found = E.best_routes(spark.createDataFrame(rows, "source_file string, row_index long, vector array<double>"), spark.createDataFrame(known, "source_file string, route string, category string, subcategory string, vector array<double>"), by=["source_file"])
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {}
    for inventory, k, v in rows:
        own = [(-cos(v, x), route) for i, route, _, _, x in known if i is None or i == inventory]
        want[k] = (min(own)[1], round(-min(own)[0], 9))
    assert {r["row_index"]: (r["route"], round(r["score"], 9)) for r in found.collect()} == want
    ruled = spark.createDataFrame([("a", "SQL1", "override"), ("b", "SQL1", "override"), ("b", "x", "default"), (None, "SQL2", "override")], "source_file string, vm_name string, classification_confidence string").withColumns({"workload_category": F.lit("Database"), "workload_subcategory": F.lit("Oracle")})
    base = spark.createDataFrame([("db", "Database", "Oracle", "oracle database")], "route string, category string, subcategory string, utterance string")
    assert {(r["source_file"], r["route"], r["utterance"]) for r in E.learned_exemplars(ruled, base, by=["source_file"]).collect()} == {(None, "db", "oracle database"), ("a", "learned:Database/Oracle", "SQL1"), ("b", "learned:Database/Oracle", "SQL1")}
