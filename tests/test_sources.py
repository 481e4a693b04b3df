import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stratasize.functions import tables as T
from stratasize.sources import columns as A
from stratasize.sources import readers as R
from stratasize.sources import sinks as W

SAMPLE = """﻿VM Name ,VM OS,Virtual Disk Size (MiB),Guest VM Disk Used (MiB),Template,Power State,Datacenter,Cluster
WEBSRV01,Microsoft Windows Server 2019,61440,28672,False,poweredOn,DC-Paris,CL-Prod
SQLSRV01,,n/a,NaN,False,poweredOff,DC-Paris,
TMPL,Linux,10,5,True,poweredOff,DC-Paris,CL-Prod
"""


def workbook(sheets):
    """A minimal workbook with inline texts and numbers."""
    col = lambda i: chr(ord("A") + i)

    def cell(i, r, v):
        return f'<c r="{col(i)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{col(i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="rId{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


VINFO = [
    ["VM", "Powerstate", "Template", "OS according to the VMware Tools", "Provisioned MiB", "In Use MiB", "Total disk capacity MiB", "Path", "VM UUID"],
    ["normal", "poweredOn", "False", "Linux", 200000, 120000, 100000, "[vsan1] a/a.vmx", "u1"],
    ["container", "poweredOn", "False", "Linux", 20000, 20000, 10000, "[vsan1] b", "u2"],
    ["raw", "poweredOn", "False", "Linux", 160000, 80000, 80000, "[vsan1] c", "u3"],
    ["notools", "poweredOn", "False", "Linux", 50000, 45000, 40000, "[vsan1] d", "u4"],
    ["fallback", "poweredOn", "False", "Linux", 30000, 15000, 0, "[vsan1] e", "u5"],
]
VPARTITION = [["VM", "VM UUID", "Capacity MiB", "Consumed MiB"], ["normal", "u1", 95000, 60000], ["container", "u2", 500000, 300000], ["raw", "u3", 20000, 20000], ["raw", "u3", 10000, 5000]]
VDATASTORE = [["Name", "Type"], ["vsan1", "vsan"], ["fc1", "VMFS"]]


def test_csv_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text(SAMPLE)
    raw = R.read_csv(spark, str(tmp_path / "a.csv"))
    assert R.detect(raw.columns, csv=True) == "liveoptics_csv"
    rows = {r["vm_name"]: r for r in R.inventory({"VMs": raw}, "liveoptics_csv").collect()}
    assert set(rows) == {"WEBSRV01", "SQLSRV01"}
    assert rows["WEBSRV01"]["provisioned_mib"] == 61440 and rows["WEBSRV01"]["is_powered_on"]
    assert (rows["SQLSRV01"]["provisioned_mib"], rows["SQLSRV01"]["in_use_mib"], rows["SQLSRV01"]["os_name"], rows["SQLSRV01"]["cluster"]) == (0, 0, "", "")
    assert rows["SQLSRV01"]["peak_iops"] is None


def test_latin1_is_found(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("VM Name,VM OS\nécole,x\n".encode("latin-1"))
    assert [tuple(r) for r in R.encodings(spark, str(tmp_path / "b.csv")).collect()] == [("ISO-8859-1", 1)]
    assert R.read_csv(spark, str(tmp_path / "b.csv")).first()["VM Name"] == "école"


def test_each_file_has_its_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("VM Name,VM OS\nécole,x\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("VM Name,VM OS,More\nçà,y,z\n".encode())
    assert {tuple(r) for r in R.read_csv(spark, str(tmp_path)).select("VM Name", "VM OS", "More").collect()} == {("école", "x", None), ("çà", "y", "z")}


def test_each_file_has_its_header(spark, tmp_path):
    """Columns in another order, other columns, quotes, new lines in cells, short rows, and an empty file."""
    (tmp_path / "a.csv").write_text("VM Name,VM OS\nvm1,linux\nvm3,\n")
    (tmp_path / "b.csv").write_text('\ufeff"VM OS", VM Name ,Note\n"windows, old",vm2,"two\nlines ""q"" é"\nx,vm4\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_bytes("Note,Note,VM Name\nà,b,VM Name\nVM Name,b,VM Name\n".encode("latin-1"))
    found = R.read_csv(spark, str(tmp_path), origin=True)
    assert found.columns[:2] == ["source_file", "row_no"] and set(found.columns[2:]) == {"VM Name", "VM OS", "Note"}
    rows = {(r["source_file"].rpartition("/")[2], r["row_no"]): (r["VM Name"], r["VM OS"], r["Note"]) for r in found.collect()}
    assert rows == {
        ("a.csv", 0): ("vm1", "linux", None), ("a.csv", 1): ("vm3", "", None), ("b.csv", 0): ("vm2", "windows, old", 'two\nlines "q" é'), ("b.csv", 1): ("vm4", "x", ""),
        ("d.csv", 0): ("VM Name", None, "à"), ("d.csv", 1): ("VM Name", None, "VM Name"),
    }


def test_many_files_are_one_scan(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text(f"VM Name,c{i % 7}\nvm{i},{i}\n" if i % 2 else f"c{i % 7},VM Name\n{i},vm{i}\n")
    found = R.read_csv(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [_c") == 1
    assert {(r["VM Name"], next(r[f"c{k}"] for k in range(7) if r[f"c{k}"] is not None)) for r in found.collect()} == {(f"vm{i}", str(i)) for i in range(40)}


def test_long_sheet_in_little_memory():
    """A sheet of 16 MB is parsed row by row."""
    import tracemalloc

    rows = 40_000
    body = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>{r % 1000}</v></c><c r="B{r}"><v>{r}</v></c><c r="D{r}" t="inlineStr"><is><t>{"x" * 300}</t></is></c></row>' for r in range(2, rows + 2))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>t{i}</t></si>" for i in range(1000)) + "</sst>")
        z.writestr("xl/worksheets/s.xml", '<worksheet><sheetData><row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c}</t></is></c>' for c in "ABCD") + f"</row>{body}</sheetData></worksheet>")
    content = out.getvalue()
    del body, out
    tracemalloc.start()
    n = 0
    for name, at, cells in R.workbook_rows(content):
        assert name == "S" and at == n and cells == {"A": f"t{(n + 2) % 1000}", "B": str(n + 2), "C": "", "D": "x" * 300}
        n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == rows and peak < 8e6


def test_archive_member_and_repeated_keys(spark, tmp_path):
    books = ["vmware-notes.xlsx", "LiveOptics_12_VMWARE_01_02_2025.xlsx"]
    assert R.archive_member(books) == books[1] and R.archive_member(books[:1] + ["z.xlsx"]) == books[0] and R.archive_member(["a.txt"]) is None
    (tmp_path / "i.csv").write_text("key;iops\nx/y;9\nx/y;7\n")
    assert [tuple(r) for r in R.read_iops(spark, str(tmp_path / "i.csv")).collect()] == [("x/y", 7.0)]


def test_missing_columns_and_unknown_format(spark):
    with pytest.raises(A.MissingColumns, match="os_name"):
        A.resolve(["VM", "Provisioned MiB", "In Use MiB"], A.RVTOOLS, A.REQUIRED)
    with pytest.raises(R.UnknownFormat):
        R.detect(["x"], csv=False)
    assert R.detect(["vInfo", "vDisk"], csv=False) == "rvtools"


def test_first_alias_wins_by_column_or_by_row(spark):
    df = spark.createDataFrame([("a", "", "conf", "1", "1")], ["VM", "OS according to the VMware Tools", "OS according to the configuration file", "Provisioned MiB", "In Use MiB"])
    assert A.canonical(df, A.RVTOOLS, "rvtools").first()["os_name"] == ""
    assert A.canonical(df, A.RVTOOLS, "rvtools", row_wise=True).first()["os_name"] == "conf"


def test_workbooks_and_archives(spark, tmp_path):
    book = workbook({"vInfo": VINFO, "vPartition": VPARTITION, "vDatastore": VDATASTORE})
    (tmp_path / "a.xlsx").write_bytes(book)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("other.xlsx", workbook({"x": [["y"]]}))
        z.writestr("LiveOptics_1_VMWARE_01_02_2025.xlsx", workbook({"VMs": [["VM Name"], ["m"]]}))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    rows = R.read_workbooks(spark, str(tmp_path / "*.*")).cache()
    kinds = {r["source_file"].rpartition("/")[2]: r["source_format"] for r in R.detect_files(rows).collect()}
    assert kinds == {"a.xlsx": "rvtools", "b.zip": "liveoptics_xlsx"}
    assert [r["source_file"].rpartition("/")[2] for r in rows.where("reject IS NOT NULL").collect()] == ["c.xlsx"]
    own = rows.where(F.col("source_file").endswith("a.xlsx"))
    sheets = {n: R.sheet(own, n) for n in ("vInfo", "vPartition", "vDatastore")}
    assert R.sheet(own, "vDisk") is None
    found = {r["vm_name"]: (r["provisioned_mib"], r["in_use_mib"]) for r in R.inventory(sheets, "rvtools").collect()}
    assert found == {"normal": (100000, 60000), "container": (500000, 300000), "raw": (80000, 25000), "notools": (40000, 40000), "fallback": (30000, 15000)}
    from stratasize.operators.capacity import capacity_report, guest_capacity

    guest = guest_capacity(A.canonical(sheets["vInfo"], A.RVTOOLS, "rvtools", ("vm_uuid", "total_disk_capacity_mib", "vm_path")), A.named(sheets["vPartition"], A.VPARTITION), None)
    report = capacity_report(guest, A.named(sheets["vDatastore"], A.VDATASTORE)).first()
    assert (report["total_vms"], report["fallback_count"], report["vsan_vm_count"], report["pre_provisioned_mib"], report["changed"]) == (5, 1, 5, 460000, True)


def test_dimension_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿a;b;c\nDatabase;"Oracle\n";5\nDatabase;Oracle;4\n;x;1\nFile;y;bad\n')
    assert [(r["category"], r["subcategory"], r["ratio"]) for r in R.read_ratios(spark, str(tmp_path / "r.csv")).collect()] == [("Database", "Oracle", 4.0)]
    (tmp_path / "i.csv").write_text("a;b\nx/y;7\nz;bad\n")
    assert [tuple(r) for r in R.read_iops(spark, str(tmp_path / "i.csv")).collect()] == [("x/y", 7.0)]
    assert T.ratios(spark).count() == 42 and T.iops(spark).count() == 8
    with pytest.raises(ValueError, match="no exemplars"):
        T.exemplars(spark, [])


def test_snapshot_and_findings(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"))], "row_index long, drr double")
    W.save_snapshot(rows, str(tmp_path / "s"), {"model": "x"})
    back, parameters = W.restore_snapshot(spark, str(tmp_path / "s"))
    assert back.first()["drr"] is None and parameters == '{"model": "x"}'
    spark.createDataFrame([(99, "{}")], "schema_version int, parameters string").write.mode("overwrite").parquet(str(tmp_path / "s/run"))
    with pytest.raises(W.WrongVersion):
        W.restore_snapshot(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], "severity string, check_id string, remediation string, affected_count long, cluster string")
    W.write_findings(none, str(tmp_path / "f"))
    text = "".join(p.read_text(encoding="utf-8-sig") for p in (tmp_path / "f").glob("*.csv"))
    assert text.strip() == "severity,check_id,title,detail,remediation,affected_count,cluster"
