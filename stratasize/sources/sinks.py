"""Written results: report tables, findings, and snapshots of a run."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.functions.tables import as_json

SNAPSHOT_VERSION = 1
#: Columns of a findings file, in order (fixed values).
FINDING_COLUMNS = ("severity", "check_id", "title", "detail", "remediation", "affected_count", "cluster")


class WrongVersion(ValueError):
    """A snapshot that another version wrote."""


def null_for_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.nan_to_null(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}) if any(t in ("double", "float") for _, t in df.dtypes) else df


def safe_texts(df: DataFrame) -> DataFrame:
    """df with texts that a spreadsheet would take for formulas quoted."""
    texts = {c: X.safe_cell(F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.withColumns(texts) if texts else df


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings with the keys of their title and detail, in the columns of a findings file."""
    key = F.concat(F.lit("health."), F.substring_index("check_id", ".", -1))
    return findings.withColumns({"title": F.concat(key, F.lit(".title")), "detail": F.concat(key, F.lit(".detail"))}).select(*FINDING_COLUMNS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, for what is read several times: it is computed once, and the
    table survives lost executors. Where the folder is unset, a temporary one is set for a local master only."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """A CSV with a header, even without findings, and a byte order mark in its first cell: one file, since findings are
    few (a row for each check and cluster)."""
    rows = safe_texts(finding_rows(findings)).orderBy("severity", "check_id", "cluster").coalesce(1)
    rows.withColumnRenamed("severity", "﻿severity").write.option("header", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table in a folder by its name; CSV cells are made safe."""
    for name, df in tables.items():
        out = safe_texts(df) if form == "csv" else df
        out.write.format(form).option("header", True).save(f"{path}/{name}")


def save_snapshot(rows: DataFrame, path: str, parameters: dict) -> None:
    """A run's rows and parameters; NaN becomes null."""
    null_for_nan(rows).write.parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(SNAPSHOT_VERSION, as_json(parameters))], "schema_version int, parameters string").write.parquet(f"{path}/run")


def restore_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(rows, parameters as JSON). Raises WrongVersion if another version wrote it."""
    run = spark.read.parquet(f"{path}/run").first()
    if run["schema_version"] != SNAPSHOT_VERSION:
        raise WrongVersion(f"snapshot version {run['schema_version']}; this is {SNAPSHOT_VERSION}")
    return spark.read.parquet(f"{path}/rows"), run["parameters"]
