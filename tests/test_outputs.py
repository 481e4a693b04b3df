"""Report tables on disk, scope choices and display columns."""

import csv

from pyspark.sql import functions as F

from stratasize.operators.filters import scope_choice
from stratasize.sources.columns import display_columns
from stratasize.sources.sinks import write_tables


def test_tables_come_back_as_written(spark, tmp_path):
    """Also without rows, under names of their own, with nulls."""
    rows = spark.createDataFrame([(1, "=cmd", 0.5), (2, None, None), (3, "-2", 1.5)], "n int, text string, x double")
    tables = {"rows": rows, "none": rows.limit(0)}
    write_tables(tables, str(tmp_path / "parquet"))
    for name, df in tables.items():
        back = spark.read.parquet(f"{tmp_path}/parquet/{name}")
        assert back.schema == df.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_cells_are_no_formulas(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=cmd"), (2, "+1"), (3, "@a"), (4, "plain"), (5, "a=b")], "n int, text string")
    write_tables({"cells": rows}, str(tmp_path), "csv")
    found = {}
    for file in (tmp_path / "cells").glob("*.csv"):
        with file.open(newline="") as f:
            found |= {int(r["n"]): r["text"] for r in csv.DictReader(f)}
    assert found == {1: "'=cmd", 2: "'+1", 3: "'@a", 4: "plain", 5: "a=b"}


def test_a_choice_of_everything_is_none():
    assert scope_choice(["b", "a"], ["a", "b"]) == []
    assert scope_choice(["b", "a", "b"], ["a", "b", "c"]) == ["a", "b"]
    assert scope_choice([], ["a"]) == []
    assert scope_choice([], []) == [] and scope_choice(["a"], []) == []


def test_display_columns_in_their_order(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("c"))
    assert display_columns(df, ["c", "missing", "a"]).columns == ["c", "a"]
    assert display_columns(df, []).columns == []
