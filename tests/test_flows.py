import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratasize.functions import tables as T
from stratasize.plans import fixtures as fx
from stratasize.plans import flows
from stratasize.plans import queries as Q
from stratasize.streaming import ingest as L

from test_sources import workbook

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    text = lambda d: d[cols].map(lambda x: round(x, 5) if isinstance(x, float) else x).astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(text(a), text(b))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    same(Q.QUERIES[name](spark, small).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df())


def test_report_and_layout(spark, small):
    rows = Q.classified(spark, small)
    tables = flows.report(spark, rows, datacenters=["ASIA"], model="powervault")
    assert {r["drr"] for r in tables["machines"].collect()} == {1.0} and tables["summary"].count() >= 11
    out = flows.layout(spark, rows.limit(200))
    assert out["placement"].count() == 600 and out["recommendation"].count() == 1


def test_similarity_needs_no_rule(spark, small):
    even = F.col("row_index") % 2 == 0
    rows = fx.inventory(spark, small).where("row_index < 60").withColumns({"vm_name": F.when(even, "kubernets wrker nod").otherwise(F.col("vm_name")), "os_name": F.lit("")})
    found = flows.classified(rows, T.exemplars(spark), learn=False).where(even).collect()
    assert len(found) == 30 and {(r["workload_category"], r["classification_confidence"]) for r in found} == {("Containers", "semantic")}
    assert flows.classified(rows, T.exemplars(spark), learn=True).where("classification_confidence = 'semantic'").count() >= 30


def test_streams(spark, tmp_path):
    """Exports of changing headers and formats, one that is sent again, broken ones, and templates."""
    (tmp_path / "in").mkdir()
    csv = "VM Name,VM OS,Virtual Disk Size (MiB),Guest VM Disk Used (MiB)\nvm1,Linux,10,5\n"
    book = workbook({"vInfo": [["VM", "Template", "VM UUID", "OS according to the VMware Tools", "Provisioned MiB", "In Use MiB"], ["t", "True", "u0", "x", 1, 1], ["w", "False", "u1", "Linux", 100, 50]], "vDisk": [["VM UUID", "Capacity MiB"], ["u1", 70]]})
    sent = [
        {"1.csv": csv.encode()},
        {"2.csv": b"VM OS,Template,VM Name,Guest VM Disk Used (MiB),Virtual Disk Size (MiB)\nWindows,False,vm2,6,20\nWindows,True,tmpl,6,20\n", "again.csv": csv.encode(), "a.xlsx": book},
        {"copy.xlsx": book, "broken.xlsx": b"PK no workbook", "other.csv": b"a,b\n1,2\n", "short.csv": b"VM Name,VM OS\nx,y\n"},
        {"b.xlsx": workbook({"vInfo": [["VM", "VM UUID", "OS according to the VMware Tools", "Provisioned MB", "In Use MB"], ["w", "u1", "Linux", 7, 3]]})},
    ]
    for files in sent:
        for name, content in files.items():
            (tmp_path / "in" / name).write_bytes(content)
        L.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/machines"))
    name = lambda r: r["source_file"].rpartition("/")[2]
    found = {(name(r), r["vm_name"]): (r["os_name"], r["provisioned_mib"], r["in_use_mib"], r["row_index"]) for r in rows.collect()}
    assert found == {("1.csv", "vm1"): ("Linux", 10, 5, 0), ("2.csv", "vm2"): ("Windows", 20, 6, 0), ("a.xlsx", "w"): ("Linux", 70, 50, 0), ("b.xlsx", "w"): ("Linux", 7, 3, 0)}
    rejects = {name(r): r["reject"] for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()}
    assert set(rejects) == {"broken.xlsx", "other.csv", "short.csv"} and rejects["short.csv"] == "missing columns: provisioned_mib, in_use_mib"
    stream = spark.readStream.schema("vm_name string, workload_category string, provisioned_mib double, drr double, source_format string, batch_id int").parquet(str(tmp_path / "out/machines"))
    q = L.running_groups(stream).writeStream.format("memory").queryName("groups").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("groups").first()["vm_count"] == 4
