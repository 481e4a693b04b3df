import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.functions import rules as P
from stratasize.functions import tables as T
from stratasize.operators import classify as E
from stratasize.operators import health as H
from stratasize.operators import layout as J
from stratasize.operators import merge as M
from stratasize.operators import ratios as R
from stratasize.operators import reports as K
from stratasize.operators import sizing as S


def one(spark, expression, **values):
    return spark.createDataFrame([values]).select(expression.alias("x")).first()["x"]


def test_numbers_and_texts(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), ("NaN",), (None,), (" 7 ",)], "c string")
    assert [r[0] for r in df.select(X.number(F.col("c"))).collect()] == [12.5, 0, 0, 0, 7]
    assert [r[0] for r in df.select(X.whole(F.col("c"))).collect()] == [12, 0, 0, 0, 7]
    assert one(spark, X.truth(F.col("c")), c="False") is False and one(spark, X.truth(F.col("c")), c="yes") is True
    assert one(spark, X.file_name(F.col("c")), c="  a/b: c!") == "a_b_c" and one(spark, X.file_name(F.col("c")), c="!!") == "report"
    assert one(spark, X.storage_text(F.lit(2097152.0)), c="") == "2,048.0 GiB (2.00 TiB)"
    assert one(spark, X.safe_cell(F.col("c")), c="=1+1") == "'=1+1"
    assert one(spark, X.label_subcategory(F.col("c")), c="a / b / c") == "b / c" and one(spark, X.label_subcategory(F.col("c")), c="a") is None
    assert one(spark, X.scope_suffix(F.array(*[F.lit(x) for x in "abcde"])), c="") == "a-b-c-and2more"


CASES = {
    "SrvSAP02": "SAP Traditional", "GISAPP01": None, "PG-ENC-1": "PostgreSQL Encrypted", "PGSQL-ENC-1": "SQL TDE", "MYSQL01": "MySQL / NoSQL", "ORA-HCC-TDE": "Oracle HCC + TDE", "db2": "DB2", "DB2500": None, "S4P1": "SAP HANA",
    "worker1.oc": "Containers", "opsmaster-p03": None, "MAIL-1": "Email", "mailarch-p01": "File Archive", "SRVFS01": "File General Purpose", "LOGIN1": None, "srvlog01": "Logging Analytics", "infradc": "Domain Controller / AAD",
    "SIEMENS": None, "x-CVM": "Nutanix CVM", "scvm": None, "ÉCOLE-SQL": "Microsoft SQL", "VDI-PROFIL": "VDI Profiles",
}


def test_rules_by_name(spark):
    df = spark.createDataFrame([(i, n, "") for i, n in enumerate(CASES)], "row_index long, vm_name string, os_name string")
    found = {r["vm_name"]: r["classification_rule"] for r in E.classify(df).collect()}
    assert found == {n: f"override:{r}" if r else "default" for n, r in CASES.items()}


def test_passes_of_the_registry(spark):
    rows = [("x", "Windows Server 2019", "", ""), ("x", "Windows Server 2019", "Cisco Unity Connection", ""), ("x", "", "Veeam server", ""), ("x", "", "", "/dc/EXCH/"), ("x", "FortiOS", "", ""), ("x", "Linux", "note", "")]
    df = spark.createDataFrame(rows, "vm_name string, os_name string, vm_description string, vm_folder string")
    found = [(r["classification_rule"], r["classification_confidence"]) for r in E.classify_by_registry(df).collect()]
    assert found == [
        ("Windows Server (OS fallback)", "os_fallback"), ("Cisco Unified Communications", "rule_match"), ("default", "default"), ("Microsoft Exchange (folder)", "rule_match"), ("Logging Analytics", "rule_match"),
        ("Linux (OS fallback)", "os_fallback"),
    ]


def test_all_mode_and_prefixes(spark):
    rule = P.Rule("both", "c", "s", 1, names=("CVM",), folders=("/NTNX",), mode="all")
    df = spark.createDataFrame([("acme-cvm", "/NTNX"), ("cvm", "/x")], "vm_name string, vm_folder string")
    assert [r["classification_rule"] for r in E.classify_by_registry(df, [rule], ["^ACME[-_]"]).collect()] == ["both", "default"]


def test_cascade_with_similarity_and_reroute(spark):
    df = spark.createDataFrame([(1, "foo", "", 10.0), (2, "bar", "", 10.0), (3, "baz", "", 2e5), (4, "oracle1", "", 2e5)], "row_index long, vm_name string, os_name string, provisioned_mib double")
    alike = spark.createDataFrame([(1, "learned:Email/x", "Email", "x", 0.84), (2, "r", "VDI", "y", 0.49)], "row_index long, route string, category string, subcategory string, score double")
    found = {r["row_index"]: (r["workload_category"], r["classification_rule"], r["classification_confidence"]) for r in E.classify(df, similarity=alike).collect()}
    assert found == {1: ("Email", "semantic:Email/x (score 0.84)", "semantic"), 2: (T.UNKNOWN, "default", "default"), 3: ("File", "Large generic (>=100 GiB)", "default"), 4: ("Database", "override:Oracle Database", "override")}


def test_routes_by_matrix_and_by_join_agree(spark):
    e = spark.createDataFrame([(f"r{i % 3}", "c", "s", [float(i), 1.0, float(i % 2)]) for i in range(7)], "route string, category string, subcategory string, vector array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [5.0, 1.0, 0.0])], "row_index long, vector array<double>")
    a, b = (sorted((r["row_index"], r["route"], round(r["score"], 9)) for r in E.best_routes(v, e, bound=n).collect()) for n in (100, 2))
    assert a == b and [x[0] for x in a] == [1, 4]
    assert E.fit_thresholds(spark.createDataFrame([("r", "r", 0.9), ("r", "q", 0.2)], "route string, label string, score double"), [0.1, 0.5]).first()["threshold"] == 0.5


def test_every_rule_has_a_ratio(spark):
    rules = spark.createDataFrame([(r.category, r.subcategory) for r in P.default_rules()], "category string, subcategory string")
    assert R.rules_without_ratio(rules, T.ratios(spark)).count() == 0
    assert {tuple(r) for r in R.ratios_without_rule(rules, T.ratios(spark)).collect()} == {("Custom DRR", "Custom DRR"), ("Web Servers", "Content not included")}


def test_merge_keeps_blanks_unless_told(spark):
    kinds = "vm_name string, os_name string, provisioned_mib double, in_use_mib double, peak_throughput_mbs double"
    a = spark.createDataFrame([("VM-1", "", 10.0, 5.0, None), ("only-a", "x", 1.0, 1.0, None)], kinds)
    b = spark.createDataFrame([(" vm-1 ", "Linux", 20.0, 7.0, 3.5), ("only-b", "y", 2.0, 0.0, None)], kinds)
    for merge in (M.merge_sources, M.merge_skewed_sources):
        rows = {r["vm_name"]: r for r in merge(a, b).collect()}
        assert (rows["VM-1"]["os_name"], rows["VM-1"]["provisioned_mib"], rows["VM-1"]["in_use_mib"], rows["VM-1"]["peak_throughput_mbs"]) == ("", 10.0, 7.0, 3.5)
        assert rows["only-b"]["in_use_mib"] is None and rows["only-b"]["is_powered_on"] is True and rows["only-b"]["hw_version"] == 0
    assert {r["os_name"] for r in M.merge_sources(a, b, treat_blank_as_null=True).collect()} == {"Linux", "x", "y"}
    assert tuple(M.merge_statistics(a, b).first()) == (3, 1, 1, 1)


def test_sizing_check_values(spark):
    df = spark.createDataFrame([(0, "a", "Database", 10000.0, 5.0, None), (1, "b", "VDI", 20000.0, 2.0, None), (2, "c", "File", 5000.0, 10.0, None)], "row_index long, vm_name string, workload_category string, provisioned_mib double, drr double, peak_iops double")
    total = S.grand_summary(S.size_machines(df)).first()
    assert total["total_required_mib"] == 12500 and total["largest_vm_name"] == "b" and total["max_vm_peak_iops_name"] == "" and not total["has_performance_data"]
    assert S.grand_summary(S.size_machines(df.limit(2))).first()["weighted_avg_drr"] == 2.5
    assert S.size_machines(df.withColumn("drr", F.lit(-1.0))).first()["drr"] == 5.0
    empty = S.grand_summary(S.size_machines(df.limit(0))).first()
    assert (empty["total_vms"], empty["weighted_avg_drr"], empty["largest_vm_name"]) == (0, 0.0, "")
    assert [tuple(r) for r in K.flow_edges(S.workload_groups(S.size_machines(df.limit(1)))).collect()] == [("Before", "Database", 9.8), ("After", "Database", 2.0)]


def machine(i, **over):
    base = {"row_index": i, "vm_name": f"vm{i}", "os_name": "Linux", "workload_category": "Database", "provisioned_mib": 1.0, "num_cpus": 1, "memory_mib": 1.0, "cluster": "C", "is_powered_on": True, "is_template": False, "hw_version": 19, "tools_status": "toolsOk", "peak_iops": 1.0}
    return base | over


@pytest.mark.parametrize(
    ("over", "check"),
    [
        ({"os_name": " "}, "data_quality.missing_os"), ({"provisioned_mib": 0.0}, "data_quality.zero_provisioned"), ({"num_cpus": 0}, "data_quality.missing_cpu"), ({"memory_mib": 0.0}, "data_quality.missing_ram"),
        ({"peak_iops": 100001.0}, "sizing_risk.iops_budget_exceeded"), ({"cluster": ""}, "best_practice.no_cluster"), ({"hw_version": 13}, "best_practice.very_old_hw_version"), ({"hw_version": 16}, "best_practice.old_hw_version"),
        ({"tools_status": "toolsNotInstalled"}, "best_practice.tools_not_installed"), ({"tools_status": "toolsNotRunning"}, "best_practice.tools_not_running"),
        ({"workload_category": "Unknown (Reducible)", "provisioned_mib": 2e6}, "sizing_risk.large_unknown_vms"),
    ],
)
def test_one_check_at_a_time(spark, over, check):
    rows = spark.createDataFrame([machine(i) for i in range(9)] + [machine(9, **over)])
    found = H.run_health_checks(rows).collect()
    assert [(r["check_id"], r["affected_count"], r["affected_vms"], r["severity"]) for r in found] == [(check, 1, ["vm9"], H.CHECKS[check])]


def test_shares_clusters_and_nothing(spark):
    rows = spark.createDataFrame([machine(i, is_powered_on=i > 2, cluster="small" if i > 7 else "C", workload_category="Unknown" if i % 2 else "x") for i in range(10)])
    found = {r["check_id"]: (r["affected_count"], r["cluster"], len(r["affected_vms"])) for r in H.run_health_checks(rows).collect()}
    assert found == {"sizing_risk.high_unknown_ratio": (4, "", 4), "best_practice.small_cluster_ha": (2, "small", 2)}
    off = spark.createDataFrame([machine(i, is_powered_on=i > 3) for i in range(10)])
    assert [(r["check_id"], r["affected_count"]) for r in H.run_health_checks(off).collect()] == [("data_quality.high_powered_off_ratio", 4)]
    assert H.run_health_checks(off.limit(0)).count() == 0


def test_greedy_packers():
    rows = pd.DataFrame({"required_mib": [60.0, 50.0, 40.0, 30.0], "peak_iops": [1.0, 1.0, 1.0, 900.0]})
    assert J.best_fit(rows, 100.0, 1000.0, 10) == [0, 1, 1, 0]
    assert J.best_fit(rows, 100.0, 1000.0, 1) == [1, 2, 3, 0]
    assert J.least_loaded(rows, 100.0, 1e9, 10) == [0, 1, 1, 0]


def test_proposals_keep_limits(spark):
    c = J.Constraints(max_mib=1000, max_machines=4)
    rows = [(i, float((i * 37) % 500 + 1) if i else 900.0, float(i * 11 % 700), "Database/Oracle" if i % 3 else "Email/Exchange") for i in range(60)]
    vms = spark.createDataFrame(rows, "row_index long, required_mib double, peak_iops double, workload_key string").withColumn("avg_iops", F.lit(0.0))
    placed = J.all_proposals(vms, T.iops(spark), c)
    assert {r["strategy"]: r["n"] for r in placed.groupBy("strategy").agg(F.count_distinct("row_index").alias("n")).collect()} == {"consolidation": 60, "performance": 60, "uniform": 60}
    stores = J.datastores(placed, vms).collect()
    assert all(s["used_mib"] <= s["usable_mib"] + 1e-6 for s in stores)
    assert all(s["vm_count"] <= 4 for s in stores if s["strategy"] != "uniform" and "HOT" not in s["datastore"])
    assert any(s["datastore"] == "DS_CONSOL_OVER_01" and s["raw_mib"] == pytest.approx(900 / 0.68) for s in stores)
    metrics = J.layout_metrics(J.datastores(placed, vms))
    assert J.comparison(metrics).count() == len(J.METRICS) and J.recommend(metrics, vms).first()["strategy"] in ("performance", "uniform")
    for other in (J.place_by_classes(vms, c), J.place_by_classes(vms, c, salts=3)):
        assert all(s["used_mib"] <= s["usable_mib"] + 1e-6 and s["vm_count"] <= 4 for s in J.datastores(other, vms).collect())
    dealt = J.deal_evenly(vms, c, part_machines=20)
    assert dealt.count() == 59 and dealt.select("row_index").distinct().count() == 59


def test_default_iops_only_without_measurements(spark):
    vms = spark.createDataFrame([(1, 0.0, 0.0, "Database/Oracle"), (2, 0.0, 0.0, "x")], "row_index long, peak_iops double, avg_iops double, workload_key string")
    assert {(r["peak_iops"], round(r["avg_iops"], 3)) for r in J.with_default_iops(vms, T.iops(spark)).collect()} == {(800.0, 560.0), (50.0, 35.0)}
    some = vms.withColumn("peak_iops", F.when(F.col("row_index") == 1, 5.0).otherwise(0.0))
    assert {r["peak_iops"] for r in J.with_default_iops(some, T.iops(spark)).collect()} == {5.0, 0.0}


def scanned_best_fit(space, iops, usable, budget, most):
    """Every bin is looked at for every machine."""
    used, busy, count, out = [], [], [], [0] * len(space)
    share = [max(a / usable, b / budget) for a, b in zip(space, iops)]
    for i in sorted(range(len(space)), key=lambda i: -share[i]):
        fits = [b for b in range(len(used)) if used[b] + space[i] <= usable and busy[b] + iops[i] <= budget and count[b] < most]
        b = max(fits, key=lambda b: used[b]) if fits else len(used)
        if b == len(used):
            used, busy, count = [*used, 0.0], [*busy, 0.0], [*count, 0]
        used[b], busy[b], count[b], out[i] = used[b] + space[i], busy[b] + iops[i], count[b] + 1, b
    return out


def scanned_least_loaded(space, iops, usable, budget):
    n = max(math.ceil(sum(space) / usable), math.ceil(sum(iops) / budget), 1)
    used, out = [0.0] * n, [0] * len(space)
    for i in sorted(range(len(space)), key=lambda i: -space[i]):
        b = min(range(len(used)), key=lambda b: used[b])
        if used[b] + space[i] > usable:
            b = len(used)
            used.append(0.0)
        used[b] += space[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(8))
def test_ordered_bins_equal_a_scan(seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.choice([0.0, 5.0, 10.0, 50.0]), lambda: rng.random() * 60, lambda: rng.expovariate(0.1) % 100]
    space, iops = [kinds[seed % 3]() for _ in range(900)], [rng.choice([0.0, 1.0, 400.0, 900.0 * rng.random()]) for _ in range(900)]
    rows = pd.DataFrame({"required_mib": space, "peak_iops": iops})
    assert J.best_fit(rows, 100.0, 1000.0, 12) == scanned_best_fit(space, iops, 100.0, 1000.0, 12)
    assert J.least_loaded(rows, 100.0, 1000.0, 12) == scanned_least_loaded(space, iops, 100.0, 1000.0)


def test_open_bins_split_and_empty():
    open_, rng, held = J.OpenBins(block=4), random.Random(2), {}
    for step in range(3000):
        if held and rng.random() < 0.45:
            b = rng.choice(list(held))
            open_.remove(held.pop(b)[0], b)
        else:
            held[step] = (rng.choice([1.0, 2.5, rng.random() * 9]), rng.random() * 10)
            open_.add(*held[step], step)
        space, iops = rng.random() * 9, rng.random() * 10
        fits = [b for b, (u, p) in held.items() if u + space <= 10 and p + iops <= 10]
        assert open_.fullest(space, iops, 10, 10) == max(fits, key=lambda b: (held[b][0], -b), default=None)


def test_groups_of_any_size(spark):
    """Groups beyond a task's machines are split and come within 2 % of the exact greedy's datastores."""
    rng, c = random.Random(4), J.Constraints(max_mib=1000, max_machines=25)
    rows = [(i, i % 3 if i % 3 else None, 800.0 if i % 500 == 7 else rng.expovariate(0.02) % 600, rng.choice([1.0, 600.0, 9000.0 * rng.random()]), rng.choice(["Database/x", "Web/y", "SAP HANA/z"])) for i in range(6000)]
    vms = spark.createDataFrame(rows, "row_index long, cluster int, required_mib double, peak_iops double, workload_key string").cache()
    for make in (J.consolidation, J.performance, J.uniform):
        exact, split = (make(vms, c, ["cluster"], part_machines=n).cache() for n in (10_000, 400))
        assert {r[0] for r in exact.select("packing").distinct().collect()} == {"alone", "exact"} and "split" in {r[0] for r in split.select("packing").distinct().collect()}
        counts = [p.select("cluster", "datastore").distinct().count() for p in (exact, split)]
        assert counts[1] <= 1.02 * counts[0] or make is J.uniform and counts[1] <= 1.05 * counts[0]
        for placed in (exact, split):
            assert placed.count() == 6000 == placed.select("row_index").distinct().count()
            stores = J.datastores(placed, vms, ["cluster"]).where("vm_count > 1")
            assert stores.where("used_mib > usable_mib + 1e-6").isEmpty()
            if make is not J.uniform:
                assert stores.where("total_iops > 100000 + 1e-6 OR vm_count > 25").isEmpty()
        alone = [sorted((r["cluster"] or 0, r["datastore"], r["row_index"]) for r in p.where("packing = 'alone'").collect()) for p in (exact, split)]
        assert alone[0] == alone[1]


def _skewed(spark):
    """100,300 machines, nearly all in one group, of few kinds, with IOPS that bind now and then."""
    of, i = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int")), F.col("id")
    rows = spark.range(100_300).select(i.alias("row_index"), F.when(i % 1000 == 3, "b").otherwise("a").alias("cluster"), (7.0 * (i * 7919 % 41) + 3).alias("required_mib"), of([1.0, 600.0, 9000.0], i % 3).alias("peak_iops"))
    return rows.withColumns({"avg_iops": F.lit(0.0), "workload_key": of(["Database/x", "Web/y", "Email/z"], F.col("row_index") % 7 % 3)})


def test_large_groups_are_packed_exactly(spark):
    """However many machines a group has, its placement is that of the greedy over all of them."""
    vms, c = _skewed(spark), J.Constraints(max_mib=1000, iops_budget=20000.0)
    placed = J.all_proposals(vms, T.iops(spark), c, ["cluster"]).toArrow().to_pandas().sort_values("row_index")
    assert set(placed.packing) == {"exact", "alone"} and len(placed) == 3 * 100_300
    for cluster, rows in vms.toArrow().to_pandas().sort_values("row_index").groupby("cluster"):
        for strategy, pack, prefix in (("consolidation", J.best_fit, "DS_CONSOL"), ("uniform", J.least_loaded, "DS_UNIFORM")):
            found = placed[(placed.cluster == cluster) & (placed.strategy == strategy)]
            assert found.datastore.tolist() == [f"{prefix}_{b + 1:02}" for b in pack(rows, c.usable_mib, c.iops_budget, c.max_machines)]


def test_datastores_of_large_groups_are_those_of_the_exact_placement(spark):
    """The figures of layout_comparison and layout_recommendation: bins are summed while their machines come."""
    vms, c = _skewed(spark), J.Constraints(max_mib=1000, iops_budget=20000.0)
    vms = vms.withColumn("workload_key", F.when(F.col("row_index") % 5 > 0, F.col("workload_key")))
    want = J.datastores(J.all_proposals(vms, T.iops(spark), c, ["cluster"], described=True), groups=["cluster"])
    found = J.all_stores(vms, T.iops(spark), c, ["cluster"])
    of = lambda df: sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()}) for r in df.select(want.columns).toArrow().to_pylist())
    got = of(found)
    assert got == of(want) and not any("_p0_" in r or "_r_" in r for r in got)


def test_recommendation_of_large_groups_is_by_the_exact_greedy(spark):
    c = J.Constraints(max_mib=1000, iops_budget=20000.0)
    vms = _skewed(spark).withColumn("peak_iops", F.least("peak_iops", F.lit(700.0)) + 600)  # all are hot, none alone
    vms = vms.withColumn("workload_key", F.when(F.pmod(F.xxhash64("row_index"), F.lit(4)) == 0, "Web/y").otherwise("Database/x"))
    found = J.recommend(J.layout_metrics(J.all_stores(vms, T.iops(spark), c, ["cluster"])), vms).first()
    rows = vms.toArrow().to_pandas().sort_values("row_index")
    kinds = []
    for _, one in rows.groupby("cluster"):
        kinds += one.assign(bin=J.best_fit(one, c.usable_mib, c.iops_budget, J.HOT_MACHINES)).groupby("bin").workload_key.nunique().tolist()
    assert found["isolation_score"] == pytest.approx(np.mean(np.array(kinds) <= 1), abs=1e-12)


def test_overfull_datastores_hand_over(spark):
    rng, c = random.Random(6), J.Constraints(max_mib=1000)
    vms = spark.createDataFrame([(i, rng.choice([5.0, 300.0, 600.0]), 1.0, "w") for i in range(500)], "row_index long, required_mib double, peak_iops double, workload_key string")
    placed = J.deal_fully(vms, c, slack=1.0, part_machines=100).cache()
    assert placed.count() == 500 == placed.select("row_index").distinct().count() and not placed.where("handed_over").isEmpty()
    assert J.datastores(placed, vms).where("used_mib > usable_mib + 1e-6").isEmpty()
