"""Row numbers over ranges, column filters, labels, and similarity in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratasize.functions import expressions as X
from stratasize.operators import classify as E
from stratasize.operators import filters as C
from stratasize.operators import layout as J


def test_global_numbers(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, *"abcdefgh"]), draw.randrange(40), i) for i in range(500)] + [("a", 1, 1)] * 300
    df = spark.createDataFrame(rows, "s string, n int, other long").repartition(7)
    got = C.numbered_globally(df, ["s", "n"]).collect()
    assert sorted(r["row_index"] for r in got) == list(range(800))
    keys = [(r["s"] or "", r["n"]) for r in sorted(got, key=lambda r: r["row_index"])]
    assert keys == sorted(keys) and got[0].asDict().keys() == {"s", "n", "other", "row_index"}
    assert C.numbered_globally(df.limit(0), ["s"]).count() == 0
    by = {}
    for r in C.numbered_by_ranges(df, ["n"], ["s"], "nth").collect():
        by.setdefault(r["s"], []).append((r["nth"], r["n"]))
    assert len(by) == 9 and all([x for x, _ in sorted(v)] == list(range(len(v))) and [n for _, n in sorted(v)] == sorted(n for _, n in v) for v in by.values())


def test_numbers_have_one_plan_at_any_size(spark):
    """More rows give no larger plan, and rows are spread over ranges."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [C.numbered_globally(spark.range(n).select(F.col("id").alias("k")), ["k"]) for n in (1_000, 300_000)]
        sizes = [len(p._jdf.queryExecution().optimizedPlan().toString()) for p in plans]
        assert abs(sizes[0] - sizes[1]) < 200 and plans[1].where("row_index <> k").isEmpty()
        assert plans[1].select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_column_filters(spark):
    df = spark.createDataFrame([("Alpha", 1.0), ("beta", 2.0), (None, None), ("", 3.0)], "t string, n double")
    text = lambda v, how: {r["t"] for r in C.where_text(df, "t", v, how).collect()}
    assert text("ALPHA", "equals") == {"Alpha"} and text("a", "ends") == {"Alpha", "beta"} and text("a", "not_contains") == {None, ""} and text("", "blank") == {None, ""} and len(text("", "equals")) == 4
    number = lambda *a: [r["n"] for r in C.where_number(df, "n", *a).orderBy("n").collect()]
    assert number(">=", 2) == [2.0, 3.0] and number("<>", 2) == [1.0, 3.0] and number("between", 1, 2) == [1.0, 2.0] and number("=", 9) == []


def test_label_of_a_bare_category(spark):
    table = [(0, "Database", "Oracle", 5.0), (1, "Database", "DB2", 1.5), (2, "File", "Archive", 1.0)]
    df = spark.createDataFrame([("Database",), ("File / General Purpose",), ("Nothing",)], "label string")
    assert [r[0] for r in df.select(X.label_subcategory(F.col("label"), table)).collect()] == ["Oracle", "General Purpose", ""]


@pytest.mark.parametrize("nearest", [1, 3])
def test_routes_in_blocks_equal_the_matrix(spark, nearest):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(5).tolist() if i % 9 else None) for i in range(60)] + [(60, [0.0] * 5), (61, [1.0])]
    known = [(f"r{i % 4}", "c", "s", rng.standard_normal(5).tolist()) for i in range(30)] + [("r9", "c", "s", [2.0])]
    vectors, exemplars = spark.createDataFrame(rows, "row_index long, vector array<double>"), spark.createDataFrame(known, "route string, category string, subcategory string, vector array<double>")
    told = lambda bound: sorted((r["row_index"], r["route"], round(r["score"], 9)) for r in E.best_routes(vectors, exemplars, nearest=nearest, bound=bound).collect())
    assert told(5) == told(1000) and len(told(5)) == 54


