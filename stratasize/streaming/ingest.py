"""Exports that keep arriving: once each into the canonical table, and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratasize.operators.filters import numbered
from stratasize.operators.sizing import size_machines, workload_groups
from stratasize.sources import readers as R
from stratasize.sources.columns import CANONICAL
from stratasize.sources.sinks import stored

#: The sheets that each format is read from.
_SHEETS = {"rvtools": {"vInfo": "vInfo", "vPartition": "vPartition", "vDisk": "vDisk"}, "liveoptics_xlsx": {"VMs": "VMs", "VM Disks": "VM Disks", "VM Performance": "VM Performance"}, "liveoptics_csv": {"VMs": "csv"}}


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files in a folder, whole: CSV exports, workbooks and archives of any header."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)


def machines(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(canonical machines of decoded files with source_file, row_no and row_index, rejects). Each file is read by its own
    headers and format; templates are left out and rows numbered within their file. Files of no known format or without
    required columns are rejects: (source_file, reject)."""
    kinds = stored(R.detect_files(rows), "export-formats")
    rejects = rows.where("reject IS NOT NULL").select("source_file", "reject").unionByName(kinds.where("source_format IS NULL").select("source_file", F.lit("no known export").alias("reject")))
    found = None
    for kind, names in _SHEETS.items():
        own = rows.join(kinds.where(F.col("source_format") == kind).select("source_file"), "source_file", "left_semi")
        bad = stored(R.lacking(own, kind), "lacking")
        rejects, own = rejects.unionByName(bad), own.join(bad, "source_file", "left_anti")
        sheets = {as_: t for as_, name in names.items() if (t := R.sheet(own, name)) is not None}
        if next(iter(names)) not in sheets:
            continue
        some = R.inventory(sheets, kind).select("source_file", "row_no", *[f.name for f in CANONICAL])
        found = some if found is None else found.unionByName(some)
    return None if found is None else numbered(found, ["row_no"]), rejects


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Appends the machines of each new export to target/machines, then stops (availableNow); target/files has the digest of
    each file, target/rejects what couldn't be read and why.

    A file whose content came before, under whatever name, is left out. The checkpoint remembers files; a batch that is
    repeated after a failure overwrites its own partitions (batch_id) and looks at the digests of earlier batches only,
    so rows come once.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        put = lambda df, name: df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/{name}")
        files = batch.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("path").alias("path"))
        known = _seen(own, f"{target}/files", batch_id)
        files = stored(files if known is None else files.join(known, "digest", "left_anti"), "new-files")
        rows = stored(R.decoded_files(batch.join(files.select("path"), "path", "left_semi"), texts=True), "new-rows")
        found, rejects = machines(rows)
        if found is not None:
            put(found, "machines")
        put(rejects, "rejects")
        put(files, "files")

    return stream_files(spark, path, files_per_trigger).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _seen(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The digests of earlier batches; None before the first one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("digest string, path string, batch_id int").parquet(path).where(F.col("batch_id") < batch_id).select("digest")


def running_groups(rows: DataFrame) -> DataFrame:
    """Totals by workload and ratio over a stream of classified machines; for output mode `update` or `complete`. Keys are
    bounded by the ratio table, so the state is."""
    return workload_groups(size_machines(rows))
