"""Joins within inventories, and any number of sources as one."""


import random

import pytest
from pyspark.sql import functions as F

from stratasize.operators import capacity as D
from stratasize.operators import merge as M
from stratasize.plans import flows
from stratasize.sources import readers as R
from stratasize.sources.columns import CANONICAL

FIELDS = "source_file string, row_no int, vm_name string, os_name string, num_cpus int, provisioned_mib double, in_use_mib double, hw_version int, vm_description string, is_template boolean, peak_iops double"


def sources(spark, seed, repeats, sites=2, count=3):
    """Sources whose names collide over sites and, with repeats, within a source."""
    rng, out = random.Random(seed), []
    for s in range(count):
        rows = []
        for site in range(sites):
            names = [f"vm{i}" for i in range(12) if rng.random() < 0.7] + ([f"VM{rng.randrange(12)} " for _ in range(4)] if repeats else []) + ["", " "]
            rows += [
                (f"site{site}", n, name, rng.choice([None, f"os{s}"]), rng.choice([None, 0, s + 1]), rng.choice([None, 10.0 * s]), rng.choice([None, 0.0, 5.0 + s]), rng.choice([None, 10 + s]), rng.choice([None, f"d{s}"]), rng.choice([None, False]), rng.choice([None, 100.0 * s]) if s else None)
                for n, name in enumerate(names)
            ]
        out.append(spark.createDataFrame(rows, FIELDS))
    return out


def plain(parts, match_blank):
    """The fold, one source after the other, by loops."""
    columns = [c for c in parts[0].columns if c != "source_file"]
    done = None
    for rank, df in enumerate(parts):
        rows = [r.asDict() for r in df.collect()]
        for r in rows:
            r["key"] = r["vm_name"].strip().lower()
            if rank:
                r["hw_version"] = r["vm_description"] = None
        if done is None:
            done = rows
            continue
        out, met = [], set()
        for old in done:
            hits = [i for i, new in enumerate(rows) if (new["source_file"], new["key"]) == (old["source_file"], old["key"]) and (match_blank or old["key"])]
            met |= set(hits)
            for new in [rows[i] for i in hits] or [None]:
                one = dict(old)
                if new:
                    for c in columns:
                        one[c] = old[c] if old[c] is not None else new[c]
                    one["in_use_mib"] = new["in_use_mib"] if (new["in_use_mib"] or 0) > 0 else old["in_use_mib"]
                    one["peak_iops"] = new["peak_iops"] if new["peak_iops"] is not None else old["peak_iops"]
                out.append(one)
        for i, r in enumerate(rows):
            if i not in met:
                out.append(r | {"in_use_mib": r["in_use_mib"] if (r["in_use_mib"] or 0) > 0 else None} if match_blank or r["key"] else r)
        done = out
    for r in done:
        r["vm_name"], r["hw_version"], r["is_template"] = r["vm_name"].strip(), r["hw_version"] or 0, bool(r["is_template"])
    return sorted(str([r[c] for c in parts[0].columns]) for r in done)


@pytest.mark.parametrize(("seed", "repeats", "match_blank"), [(1, False, False), (2, True, False), (3, True, True), (4, False, True)])
def test_fold_equals_loops(spark, seed, repeats, match_blank):
    parts = sources(spark, seed, repeats)
    found = M.fold_sources(parts, ["source_file"], match_blank=match_blank)
    assert sorted(str([r[c] for c in parts[0].columns]) for r in found.collect()) == plain(parts, match_blank)
    assert [c for c in found.columns if c not in ("source_file", "row_no")] == [f.name for f in CANONICAL]


def test_two_sources_equal_the_merge(spark):
    first, second = sources(spark, 7, True, sites=1, count=2)
    both = [x.select(*[f.name for f in CANONICAL]).collect() for x in (M.fold_sources([first, second], match_blank=True), M.merge_sources(first, second))]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1]))


def test_fold_statistics(spark):
    parts = sources(spark, 9, True)
    names = [{(r["source_file"], r["vm_name"].strip().lower()) for r in p.collect()} for p in parts]
    want = {}
    for site, k in set().union(*names):
        kind = (site, "+".join(str(i) for i, n in enumerate(names) if (site, k) in n))
        want[kind] = want.get(kind, 0) + 1
    assert {(r["source_file"], r["sources"]): r["names"] for r in M.fold_statistics(parts, ["source_file"]).collect()} == want


def test_ids_count_within_an_inventory(spark):
    """Three exports use the same ids and names; one of them has disks without ids, so it joins by name."""
    files = ["a", "b", "c"]
    vms = spark.createDataFrame([(f, f"vm-{i}", f"n{i}", 1.0, 1.0) for f in files for i in range(4)], "source_file string, mob_id string, vm_name string, provisioned_mib double, in_use_mib double")
    disks = [(f, f"vm-{i}", f"n{(i + 1) % 4}", str(10.0 ** k), "1") for k, f in enumerate(files) for i in range(3)] + [("b", "", "n0", "5", "1"), (None, "vm-1", "n1", "99", "1")]
    found = {(r["source_file"], r["vm_name"]): r["provisioned_mib"] for r in D.override_by_disks(vms, spark.createDataFrame(disks, "source_file string, mob_id string, vm_name string, capacity_mib string, used_mib string"), ["source_file"]).collect()}
    assert len(found) == 12
    assert [found["a", f"n{i}"] for i in range(4)] == [1.0, 1.0, 1.0, 1.0] and [found["c", f"n{i}"] for i in range(4)] == [100.0, 100.0, 100.0, 1.0]
    assert [found["b", f"n{i}"] for i in range(4)] == [5.0, 10.0, 10.0, 10.0]
    samples = spark.createDataFrame([("a", "n0 ", 7.0), ("b", "n0", 9.0), ("b", "n0", 8.0)], "source_file string, vm_name string, peak_iops double")
    fast = {(r["source_file"], r["vm_name"]): r["peak_iops"] for r in D.attach_performance(vms, samples, ["source_file"]).collect()}
    assert len(fast) == 12 and (fast["a", "n0"], fast["b", "n0"], fast["c", "n0"]) == (7.0, 9.0, None)


def test_guest_capacity_of_three_exports(spark):
    """Brute force over exports with colliding ids and names, by UUID or by name."""
    rng, files = random.Random(5), ["a", "b", "c"]
    vms = [(f, f"u{i}" if rng.random() < 0.7 else "", f"n{i}", 100.0, 50.0, rng.choice([0.0, 30.0]), f"[ds{i % 3}] x") for f in files for i in range(8)]
    part = [(f, rng.choice([f"u{i}", ""]), f"n{i}", float(rng.randrange(1, 90)), float(rng.randrange(90))) for f in files for i in range(8) for _ in range(rng.randrange(3))]
    disk = [(f, f"u{i}", f"n{i}", float(rng.randrange(1, 90))) for f in files for i in range(8) for _ in range(rng.randrange(3))]
    t = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    guest = D.guest_capacity(
        t(vms, "source_file string, vm_uuid string, vm_name string, provisioned_mib double, in_use_mib double, total_disk_capacity_mib double, vm_path string"),
        t(part, "source_file string, vm_uuid string, vm_name string, capacity_mib double, consumed_mib double"), t(disk, "source_file string, vm_uuid string, vm_name string, capacity_mib double"), ["source_file"],
    )

    def looked(rows, f, u, n, at):
        for col, key in ((1, u), (2, n)):
            own = [r[at] for r in rows if r[0] == f and r[col] == key and key]
            if own:
                return sum(own)
        return None

    want = {}
    for f, u, n, prov, used, total, _ in vms:
        known = max(looked(part, f, u, n, 3) or 0, total or looked(disk, f, u, n, 3) or 0)
        out, seen = known or prov, looked(part, f, u, n, 4)
        want[f, n] = (out, min(used if seen is None else seen, out), known == 0)
    assert {(r["source_file"], r["vm_name"]): (r["provisioned_mib"], r["in_use_mib"], r["capacity_fallback"]) for r in guest.collect()} == want
    stores = t([("a", "ds0", "vSAN"), ("b", "ds0", "VMFS"), ("b", "ds1", "vsan")], "source_file string, name string, type string")
    report = {r["source_file"]: (r["total_vms"], r["vsan_vm_count"], r["fallback_count"]) for r in D.capacity_report(guest, stores, ["source_file"]).collect()}
    assert report == {f: (8, {"a": 3, "b": 3, "c": 0}[f], sum(x[2] for k, x in want.items() if k[0] == f)) for f in files}


def test_third_export_counts(spark):
    """An RVTools export and two others in one analysis; a machine of the third alone is there, and files keep apart."""
    rv = spark.createDataFrame([("a", 0, "VM1", "u1", "Linux", "100", "50"), ("b", 0, "VM1", "u1", "Linux", "200", "60")], "source_file string, row_no int, VM string, `VM UUID` string, `OS according to the VMware Tools` string, `Provisioned MiB` string, `In Use MiB` string")
    disk = spark.createDataFrame([("a", "VM1", "u1", "70"), ("b", "VM1", "u1", "90")], "source_file string, VM string, `VM UUID` string, `Capacity MiB` string")
    lo = lambda rows: spark.createDataFrame(rows, "source_file string, `VM Name` string, `VM OS` string, `Virtual Disk Size (MiB)` string, `Guest VM Disk Used (MiB)` string")
    exports = [("liveoptics_csv", {"VMs": lo([("a", "vm1", "x", "1", "40"), ("a", "vm2", "y", "2", "1")])}), ("rvtools", {"vInfo": rv, "vDisk": disk}), ("liveoptics_csv", {"VMs": lo([("b", "vm3", "z", "3", "2")])})]
    found = {(r["source_file"], r["vm_name"]): (r["provisioned_mib"], r["in_use_mib"], r["row_no"]) for r in flows.analyse(spark, exports, by=["source_file"]).collect()}
    assert found == {("a", "VM1"): (70.0, 40.0, 0), ("b", "VM1"): (90.0, 60.0, 0), ("a", "vm2"): (2.0, 1.0, None), ("b", "vm3"): (3.0, 2.0, None)}
    assert set(R.ORIGIN) == {"source_file", "row_no"}
