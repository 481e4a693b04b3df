"""Scans of inventory exports: CSV, workbooks and archives, and the dimension tables."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from array import array
from collections.abc import Iterable, Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasize.functions import expressions as X
from stratasize.functions.tables import iops as default_iops
from stratasize.operators.capacity import attach_performance, guest_capacity, override_by_disks
from stratasize.operators.filters import without_templates
from stratasize.operators.ratios import small
from stratasize.sources import columns as C
from stratasize.sources.sinks import stored

#: Bytes of a file as it is, and of what an archive holds (fixed values).
MOST_FILE, MOST_UNPACKED = 50 << 20, 100 << 20
SHEET_ROWS = "source_file string, sheet string, row_no int, cells map<string,string>, reject string"
_MAIN = {"rvtools": "vInfo", "liveoptics_xlsx": "VMs"}
#: How an assessment's workbook is named (a fixed value); the most columns that a sheet can have.
_ASSESSMENT, _MOST_HEADERS = re.compile(r"LiveOptics_\d+_VMWARE_\d{2}_\d{2}_\d{4}\.xlsx", re.I), 16_384
#: Rows of a file that leave its task together.
_ROWS_AT_ONCE = 2_000
_NUMBER = re.compile(r"([A-Z]+)\d*$")


class UnknownFormat(ValueError):
    """An export that is none of the known ones."""


def _text(content: bytes, encoding: str | None = None) -> tuple[str, str]:
    """A file's text and encoding: UTF-8, with or without a byte order mark, where it decodes as such, else ISO-8859-1."""
    for e in [encoding] if encoding else ["UTF-8", "ISO-8859-1"]:
        try:
            return content.decode("utf-8-sig" if e.upper() == "UTF-8" else e), e
        except UnicodeDecodeError:
            continue
    raise ValueError(f"not {encoding}")


def _csv_rows(text: str) -> Iterator[list[str]]:
    """The records of a CSV text that aren't blank, as Spark reads them."""
    return (r for r in csv.reader(io.StringIO(text, newline="")) if any(r))


def _clean(header: Iterable[str]) -> list[str]:
    return [c.lstrip("\ufeff").strip() for c in header]


def csv_headers(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(source_file, encoding, header) of each CSV file at a path; files are probed in tasks."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, found = _text(content or b"", encoding)
                out.append((name, found, _clean(next(_csv_rows(text), []))))
            yield pa.RecordBatch.from_pylist([dict(zip(("source_file", "encoding", "header"), r, strict=True)) for r in out], schema=pa.schema([("source_file", pa.string()), ("encoding", pa.string()), ("header", pa.list_(pa.string()))]))

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source_file"), "content")
    return files.mapInArrow(probe, "source_file string, encoding string, header array<string>")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(encoding, files): how many files at path have each encoding."""
    return csv_headers(spark, path).groupBy("encoding").agg(F.count(F.lit(1)).alias("files"))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, origin: bool = False) -> DataFrame:
    """CSV exports as texts, any number of files, each by its own header: the columns are all files' headers, trimmed, in
    the order in which they first stand. A cell is null where its file lacks the column, and empty where it is blank.

    The encoding is probed for each file where it isn't given. All files are one scan, since texts are read as bytes and
    decoded by their file's encoding; only the distinct headers' names reach the driver. Of names that a file repeats the
    first counts. With origin, source_file and row_no (a row's number in its file, from 0) stand first; numbering sorts
    each file in one task.
    """
    probed = stored(csv_headers(spark, path, encoding), "csv-headers")
    found = probed.select(F.posexplode("header").alias("at", "name")).where("name <> ''").groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in found.orderBy("at", "name").limit(_MOST_HEADERS + 1).collect()]
    if len(names) > _MOST_HEADERS:
        raise ValueError(f"more than {_MOST_HEADERS} headers over all files")
    width = probed.agg(F.max(F.size("header"))).first()[0] or 1
    cells = [f"_c{i}" for i in range(width)]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in cells), enforceSchema=True, encoding=encoding or "ISO-8859-1", multiLine=True, escape='"')
    raw = raw.select(F.array(*cells).alias("__cells"), F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__id"))
    where = F.transform(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.array_position("header", n).cast("int"))
    known = small(probed.select("source_file", (F.col("encoding") == "UTF-8").alias("__utf8"), where.alias("__where")))
    rows = raw.join(known, F.col("__file") == F.col("source_file"))
    decoded = lambda c: F.when(F.col("__utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c) if encoding is None else c

    def one(i: int, name: str) -> Column:
        at = F.col("__where")[i]
        return F.when(at > 0, F.coalesce(decoded(F.col("__cells")[at - 1]), F.lit(""))).alias(name)

    own = [] if not origin else ["source_file", (F.row_number().over(W.partitionBy("source_file").orderBy("__id")) - 1).alias("row_no")]
    return rows.select(*own, *[one(i, n) for i, n in enumerate(names)])


def detect(columns_or_sheets: set[str] | list[str], csv: bool) -> str:
    """`rvtools`, `liveoptics_xlsx` or `liveoptics_csv`, from a CSV's columns or a workbook's sheets."""
    names = {c.lstrip("﻿").strip() for c in columns_or_sheets}
    if csv and names & {"VM Name", "VM OS"}:
        return "liveoptics_csv"
    for kind, sheet in _MAIN.items():
        if not csv and sheet in names:
            return kind
    raise UnknownFormat(f"no known export; there are {sorted(names)[:10]}")


def detect_files(sheets: DataFrame) -> DataFrame:
    """(source_file, source_format) of a fleet's files; null for unknown ones."""
    said = F.coalesce(F.max((F.col("sheet") == "csv") & (F.map_contains_key("cells", F.lit("VM Name")) | F.map_contains_key("cells", F.lit("VM OS")))), F.lit(False))
    by_file = sheets.where("sheet IS NOT NULL").groupBy("source_file").agg(F.collect_set("sheet").alias("sheets"), said.alias("csv"))  # the sheets of a file
    found = F.when(F.array_contains("sheets", "vInfo"), "rvtools").when(F.array_contains("sheets", "VMs"), "liveoptics_xlsx").when(F.col("csv"), "liveoptics_csv")
    return by_file.select("source_file", found.alias("source_format"))


def lacking(sheets: DataFrame, source_format: str) -> DataFrame:
    """(source_file, reject): files of a format whose main sheet lacks required columns, and which."""
    aliases = C.RVTOOLS if source_format == "rvtools" else C.LIVEOPTICS
    main = sheets.where(F.col("sheet") == _MAIN.get(source_format, "csv")).groupBy("source_file").agg(F.max(F.map_keys("cells")).alias("keys"))
    gone = F.filter(F.array(*[F.when(~F.arrays_overlap("keys", F.array(*[F.lit(a) for a in aliases[c]])), F.lit(c)) for c in C.REQUIRED]), lambda c: c.isNotNull())
    return main.select("source_file", gone.alias("gone")).where(F.size("gone") > 0).select("source_file", F.concat(F.lit("missing columns: "), F.array_join("gone", ", ")).alias("reject"))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """SHEET_ROWS of all workbooks, and of archives that hold one, at a path or pattern; see decoded_files()."""
    return decoded_files(spark.read.format("binaryFile").load(path))


def decoded_files(files: DataFrame, texts: bool = False) -> DataFrame:
    """SHEET_ROWS of files (path, length, content): a row for each row of a sheet, its cells by header. With texts, a file
    that is no archive is read as CSV, one sheet named `csv`. Files are decoded in parallel, each in one task within a bounded size, rows as they are parsed, and
    go on in batches; those that are too large or broken come back as one row with `reject`.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([list(c.items()) if c is not None else None for c in v] if i == 3 else v, t) for i, (v, t) in enumerate(zip(columns, kinds, strict=True))], ["source_file", "sheet", "row_no", "cells", "reject"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for i in range(some.num_rows):
                path, content, rows = some.column(0)[i].as_py(), some.column(1)[i].as_py(), []
                try:
                    for found in workbook_rows(content) if content[:2] == b"PK" or not texts else csv_rows(content):
                        rows.append((path, *found, None))
                        if len(rows) == _ROWS_AT_ONCE:
                            yield batch(rows)
                            rows = []
                except (ValueError, KeyError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, str(e)[:200]))
                yield batch(rows)

    fits = F.col("length") <= MOST_FILE
    decoded = files.where(fits).select("path", "content").mapInArrow(run, SHEET_ROWS)
    large = files.where(~fits).select(F.col("path").alias("source_file"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("row_no"), F.lit(None).cast("map<string,string>").alias("cells"), F.lit("file too large").alias("reject"))
    return decoded.unionByName(large)


def csv_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(`csv`, row number, cells by header) of a CSV file. Raises ValueError for what is no text."""
    text, _ = _text(content)
    if "\x00" in text:
        raise ValueError("neither a workbook nor a text")
    header = None
    for n, row in enumerate(_csv_rows(text)):
        if header is None:
            header = _clean(row)
        else:
            yield "csv", n - 1, {h: row[i] if i < len(row) else "" for i, h in reversed(list(enumerate(header))) if h}


def archive_member(names: list[str]) -> str | None:
    """The workbook in an archive: the first that is named as an assessment of virtual machines is, else the first at all."""
    books = [n for n in names if n.lower().endswith(".xlsx") and not posixpath.basename(n).startswith((".", "~"))]
    return next((n for n in books if _ASSESSMENT.search(n)), books[0] if books else None)


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, cells by header) of a workbook, or of the one in an archive. Raises ValueError if neither."""
    book = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in book.infolist()) > MOST_UNPACKED:
        raise ValueError("archive too large when unpacked")
    if "xl/workbook.xml" not in book.namelist():
        member = archive_member(book.namelist())
        if member is None:
            raise ValueError("no workbook in the archive")
        yield from workbook_rows(book.read(member))
        return
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    shared = SharedTexts(text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")) if "xl/sharedStrings.xml" in book.namelist() else None
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
        rel = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
        part = targets[rel].lstrip("/")
        header, n = None, 0
        for row in _elements(book, part if part.startswith("xl/") else f"xl/{part}", "row"):
            cells = {}
            for c in row:
                value = next((x.text for x in c if local(x) == "v"), None)
                kind = c.get("t")
                value = shared[int(value)] if kind == "s" and value is not None else text(c) if kind == "inlineStr" else ("true" if value == "1" else "false") if kind == "b" else value
                if value not in (None, ""):
                    cells[_NUMBER.match(c.get("r", "A"))[1] if c.get("r") else str(len(cells))] = value
            if header is None:
                header = {k: v.strip() for k, v in cells.items()}
            elif cells:
                yield sheet.get("name"), n, {v: cells.get(k, "") for k, v in reversed(header.items()) if v}
                n += 1


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """The elements of one name in a part of a workbook, one at a time: each is let go before the next is parsed."""
    with book.open(part) as file:
        inside = []
        for event, e in ElementTree.iterparse(file, events=("start", "end")):
            if event == "start":
                inside.append(e)
                continue
            inside.pop()
            if e.tag.rpartition("}")[2] == name:
                yield e
                if inside:
                    inside[-1].clear()


class SharedTexts:
    """The texts that a workbook's cells point to, in one buffer."""

    def __init__(self, texts: Iterable[str]):
        self.ends, self.data = array("Q", [0]), bytearray()
        for t in texts:
            self.data += t.encode()
            self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise ValueError(f"no shared text {i}")
        return self.data[self.ends[i] : self.ends[i + 1]].decode()


def sheet(rows: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame | None:
    """One sheet of read_workbooks() as a table of texts, with source_file and row_no; None if no file has it. The
    columns are the distinct headers unless given; more than one sheet can have are an error."""
    own = rows.where(F.col("sheet") == name)
    if columns is None:
        columns = sorted(r[0] for r in own.select(F.explode(F.map_keys("cells"))).distinct().limit(_MOST_HEADERS + 1).collect())
        if len(columns) > _MOST_HEADERS:
            raise ValueError(f"sheet {name}: more than {_MOST_HEADERS} headers over all files; name the columns")
    return own.select("source_file", "row_no", *[F.col("cells")[c].alias(c) for c in columns]) if columns else None


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """The table of an optional sheet that is missing."""
    return spark.createDataFrame([], schema)


#: Columns that say where a row is from, and the one by which sheets of several files belong together.
ORIGIN, FILE = ("source_file", "row_no"), "source_file"


def inventory(sheets: Mapping[str, DataFrame], source_format: str) -> DataFrame:
    """An export's sheets as the canonical table, templates left out; source_file and row_no stay where sheets have them.
    Optional sheets may be missing.

    RVTools: guest capacity from vPartition and vDisk. LiveOptics workbooks: disks and performance from their sheets.
    Sheets may hold many files: where all of them have source_file, ids and names count within a file.
    """
    if source_format not in ("rvtools", "liveoptics_xlsx", "liveoptics_csv"):
        raise UnknownFormat(source_format)
    main = sheets[_MAIN.get(source_format, "VMs")]
    used = [main, *(sheets[s] for s in ("vPartition", "vDisk", "VM Disks", "VM Performance") if s in sheets)]
    by = [FILE] if all(FILE in t.columns for t in used) else []
    other = lambda s, aliases, need: t if s in sheets and need <= set((t := C.named(sheets[s], aliases, carry=by)).columns) else None
    if source_format == "rvtools":
        rows = C.canonical(main, C.RVTOOLS, source_format, ("vm_uuid", "total_disk_capacity_mib", "vm_path"), carry=ORIGIN)
        rows = guest_capacity(rows, other("vPartition", C.VPARTITION, {"capacity_mib"}), other("vDisk", C.VDISK, {"capacity_mib"}), by)
    elif source_format == "liveoptics_xlsx":
        rows = C.canonical(main, C.LIVEOPTICS, source_format, ("mob_id",), carry=ORIGIN)
        rows = override_by_disks(rows, other("VM Disks", C.VM_DISKS, set()), by)
        rows = attach_performance(rows, other("VM Performance", C.PERFORMANCE, {"vm_name", "peak_iops"}), by)
    else:
        rows = C.canonical(main, C.LIVEOPTICS, source_format, carry=ORIGIN)
    return without_templates(rows)


def read_ratios(spark: SparkSession, path: str) -> DataFrame:
    """(table_order, category, subcategory, ratio) from a `;` separated file of three columns: rows without a category or
    number go, of repeated pairs the last counts."""
    rows = spark.read.csv(path, sep=";", header=True, multiLine=True, inferSchema=False, encoding="UTF-8")
    rows = rows.toDF(*["category", "subcategory", "ratio", *[f"__{i}" for i in range(3, len(rows.columns))]])
    rows = rows.select(F.monotonically_increasing_id().alias("n"), X.stripped(F.col("category")).alias("category"), X.stripped(X.text_or_empty(F.col("subcategory"))).alias("subcategory"), X.number(F.col("ratio"), None).alias("ratio"))
    rows = rows.where((F.coalesce("category", F.lit("")) != "") & F.col("ratio").isNotNull())
    last = rows.groupBy("category", "subcategory").agg(F.max(F.struct("n", "ratio")).alias("b"), F.min("n").alias("n"))
    return last.select((F.row_number().over(W.orderBy("n")) - 1).alias("table_order"), "category", "subcategory", "b.ratio")


def read_iops(spark: SparkSession, path: str) -> DataFrame:
    """(workload_key, iops) from a `;` separated file; rows without a number go, of repeated keys the
    last counts; the built-in table if nothing is left."""
    rows = spark.read.csv(path, sep=";", header=True, inferSchema=False, encoding="UTF-8")
    rows = rows.toDF(*["workload_key", "iops", *[f"__{i}" for i in range(2, len(rows.columns))]])
    rows = rows.select(F.monotonically_increasing_id().alias("n"), X.stripped(F.col("workload_key")).alias("workload_key"), X.number(F.col("iops"), None).alias("iops")).where("workload_key <> '' AND iops IS NOT NULL")
    rows = rows.groupBy("workload_key").agg(F.max_by("iops", "n").alias("iops"))
    return default_iops(spark) if rows.isEmpty() else rows
