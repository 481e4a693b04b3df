"""What a task holds and how many there are: lookups of rules without a shuffle, machines dealt to all tasks, sheets read once."""

import re

import numpy as np
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.functions import tables as T
from stratasize.operators import capacity as D
from stratasize.operators import classify as E
from stratasize.operators import layout as J
from stratasize.operators.rule_index import rule_number_by_index
from stratasize.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_rules_are_looked_up_where_rows_are(spark, small):
    rows = spark.createDataFrame([(1, "SQL-1", "")], "row_index long, vm_name string, os_name string")
    found = rule_number_by_index(rows, rules := E._ordered(None), E._signals(rows, ()))
    logical, _ = plan(found)
    assert "Aggregate" not in logical and logical.count("Join") == 1  # the fields of a rule, by its number
    assert rules[found.first()["rule_no"]].name == "Microsoft SQL"


def test_machines_are_dealt_to_all_tasks(spark, small):
    """The tables are one file of one row group each."""
    logical, _ = plan(fx.inventory(spark, small))
    assert "RepartitionByExpression [o_orderkey" in logical
    rows = fx.inventory(spark, small)
    assert rows.count() == rows.select("row_index").distinct().count() == fx.table(spark, small, "orders").count()


def test_sheets_are_read_once(spark):
    vms = spark.createDataFrame([("a", "u1", "x"), ("a", "", "y"), ("b", "u1", "x"), ("b", None, "z")], "site string, vm_uuid string, vm_name string")
    sheet = spark.createDataFrame([("a", "u1", "x", 1.5), ("a", " u1 ", "y", 2.0), ("a", "", "y", 4.0), ("b", None, "x", 8.0), ("b", "u2", None, 16.0)], "site string, vm_uuid string, vm_name string, capacity_mib double")
    once = sheet.withColumn("capacity_mib", F.col("capacity_mib") + F.rand(1) * 0)
    found = D.look_up_twice(vms, once, ["capacity_mib"], "part", ["site"])
    assert "rand(" not in plan(found)[0]  # the sheet is no part of the joins any more
    assert sorted((r["site"], r["vm_name"], r["part_capacity_mib"], r["part_found"]) for r in found.collect()) == [("a", "x", 3.5, True), ("a", "y", 6.0, True), ("b", "x", 8.0, True), ("b", "z", 0.0, False)]


def test_numbers_are_no_texts(spark):
    """Doubles and integers take no way through texts and patterns; what is no number is the default as before."""
    rows = spark.createDataFrame([(1.5, 3, "7 ", 2.5), (float("nan"), None, "x", float("inf"))], "a double, b int, c string, d double")
    found = rows.select(*[X.number_in(rows, x).alias(x) for x in rows.columns])
    assert [tuple(r) for r in found.collect()] == [(1.5, 3.0, 7.0, 2.5), (0.0, 0.0, 0.0, float("inf"))] == [tuple(r) for r in rows.select(*[X.number(F.col(x)) for x in rows.columns]).collect()]
    assert ["regexp_replace" in str(X.number_in(rows, x)) for x in rows.columns] == [False, False, True, False]


def test_rules_are_compiled(spark, small, capsys):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows in (fx.inventory(spark, small), fx.described(spark, small)):
            E.classify_by_registry(rows).explain("codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_described_placements_give_the_same_datastores(spark):
    """No join with the machines, and their own IOPS, not the guessed ones, count."""
    rows = [(i, "ab"[i % 2], 10.0 * i, 0.0, 0.0, "Database/Oracle" if i % 3 else "Email/Exchange") for i in range(60)]
    vms = spark.createDataFrame(rows, "row_index long, cluster string, required_mib double, peak_iops double, avg_iops double, workload_key string")
    c = J.Constraints(max_mib=1000)
    plain, told = (J.all_proposals(vms, T.iops(spark), c, ["cluster"], part_machines=20, described=x) for x in (False, True))
    found = [J.datastores(p, vms if p is plain else None, ["cluster"]) for p in (plain, told)]
    of = lambda df: sorted(str({**r.asDict(), "used_mib": round(r["used_mib"], 6), "utilization_pct": round(r["utilization_pct"], 6)}) for r in df.collect())
    assert of(found[0]) == of(found[1]) and found[1].where("total_iops <> 0").isEmpty()
    assert plan(J.datastores(J.place_by_classes(vms, c, described=True)))[0].count("Join") == 0


def test_stores_are_summed_where_they_are_packed(spark):
    """The same datastores as from machines, of exact, split and lone ones, with nulls; and machines travel once."""
    rows = [(i, "abc"[i % 7 % 3], 10.0 * (i % 37) if i % 90 else 900.0, float(i % 5 * 70), 0.0, None if i % 13 == 0 else "Database/Oracle" if i % 3 else "Email/Exchange") for i in range(400)]
    for vms in (rows, [(*r[:3], None if r[0] % 4 else 0.0, *r[4:]) for r in rows]):  # measured, and not
        vms = spark.createDataFrame(vms, "row_index long, cluster string, required_mib double, peak_iops double, avg_iops double, workload_key string")
        c = J.Constraints(max_mib=1000, iops_budget=2000.0, max_machines=8)
        want = J.datastores(J.all_proposals(vms, T.iops(spark), c, ["cluster"], part_machines=30, described=True), groups=["cluster"])
        found = J.all_stores(vms, T.iops(spark), c, ["cluster"], part_machines=30)
        of = lambda df: sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.select(want.columns).collect())
        assert of(found) == of(want) and {"_OVER_", "_r_", "_p1_"} <= {x for x in ("_OVER_", "_r_", "_p1_") for r in found.collect() if x in r["datastore"]}
    assert "collect_set(" in plan(want)[0] and "collect_set(" not in plan(found)[0]


def test_equal_rows_are_packed_in_runs(monkeypatch):
    """Bins are looked for once for what they take of a run of equal rows, and take what they took one by one."""
    asked, take = [], J.OpenBins.take
    monkeypatch.setattr(J.OpenBins, "take", lambda *a: asked.append(1) or take(*a))
    from tests.test_operators import scanned_best_fit

    rng = np.random.default_rng(3)
    for most in (1, 7, 25):
        space, iops = rng.choice([0.0, 0.1, 7.3, 33.3, 120.0], 3000), rng.choice([0.0, 0.7, 250.0], 3000)
        asked.clear()
        assert J.best_fit({"required_mib": space, "peak_iops": iops}, 100.0, 1000.0, most) == scanned_best_fit(space, iops, 100.0, 1000.0, most)
        assert most == 1 or len(asked) < 2500


def test_classes_are_summed_without_a_shuffle_of_their_own(spark):
    """The same datastores as from machines, and the only shuffle is the one to classes, which has all tasks."""
    rows = [(i, "ab"[i % 2], 10.0 * (i % 37) if i % 90 else 900.0, float(i % 5 * 70), None if i % 13 == 0 else "Database/Oracle" if i % 3 else "Email/Exchange") for i in range(400)]
    vms = spark.createDataFrame(rows, "row_index long, cluster string, required_mib double, peak_iops double, workload_key string")
    c = J.Constraints(max_mib=1000, iops_budget=2000.0, max_machines=8)
    for groups in ([], ["cluster"]):
        want, found = J.datastores(J.place_by_classes(vms, c, groups, 3, described=True), groups=groups), J.stores_by_classes(vms, c, groups, 3)
        of = lambda df: sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.select(want.columns).collect())
        assert of(found) == of(want) and found.columns == want.columns
        physical = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert physical.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in physical
