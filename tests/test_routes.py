"""Similarity routes beyond one matrix: equal cosines, thresholds, vectors without a verdict."""

import numpy as np
from pyspark.sql import functions as F

from stratasize.operators import classify as E


def test_equal_cosines_take_the_first_route(spark):
    draw = np.random.default_rng(5)
    base = [draw.integers(0, 4, 24).astype(float) for _ in range(40)]
    rows, known, want = [], [], {}
    for i, v in enumerate(base):
        v[0] += 1
        rows.append((i, v.tolist()))
        # One vector in several lengths: the cosines are equal, whatever the rounding of their norms.
        known += [(f"r{i:02}_{j}", "c", "s", (v * f).tolist()) for j, f in enumerate((1 / 3, 7.0, 0.1, 1e-3))]
        want[i] = (f"r{i:02}_0", 1.0)
    rows += [(100, None), (101, [0.0] * 24), (102, [1.0, None] + [0.0] * 22), (103, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "row_index long, vector array<double>")
    exemplars = spark.createDataFrame([*known, ("zero", "c", "s", [0.0] * 24)], "route string, category string, subcategory string, vector array<double>")
    found = {r["row_index"]: (r["route"], r["score"]) for r in E.best_routes(vectors, exemplars, bound=2).collect()}
    assert found == want


def test_blocks_of_rows_and_exemplars_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(6)
    v, e = draw.normal(size=(150, 16)), draw.normal(size=(130, 16))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_index long, vector array<double>")
    exemplars = spark.createDataFrame([(f"r{i:03}", "c", "s", x.tolist()) for i, x in enumerate(e)], "route string, category string, subcategory string, vector array<double>")
    cos = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T
    monkeypatch.setattr(E, "PRODUCT_EXEMPLARS", 40)
    monkeypatch.setattr(E, "PRODUCT_ROWS", 60)
    for least in (None, 0.6):
        found = {r["row_index"]: (r["route"], round(r["score"], 9)) for r in E.best_routes(vectors, exemplars, bound=2, threshold=least).collect()}
        assert found == {i: (f"r{c.argmax():03}", round(c.max(), 9)) for i, c in enumerate(cos) if least is None or c.max() >= least}


def test_many_rows_and_exemplars_travel_packed(spark, monkeypatch):
    """Blocks by both tables' sizes, vectors packed; names as the query has them, against brute force with all of them."""
    names = [f"{p}{k}" for k in range(700, 1100) for p in ("SQL-SRV-", "WEB-SRV-", "MONGO-")]
    texts = [f"APP-SRV-{k}{s}" for k in range(600, 1200) for s in ("", " Windows Server")]
    vectors = spark.createDataFrame(list(enumerate(texts)), "row_index long, text string").select("row_index", E.gram_vector(F.col("text")).alias("vector")).cache()
    exemplars = spark.createDataFrame([(n[:3], "c", "s", n) for n in names], "route string, category string, subcategory string, text string")
    exemplars = exemplars.select("route", "category", "subcategory", E.gram_vector(F.col("text")).alias("vector")).cache()
    v, e = (np.array([r["vector"] for r in df.collect()]) for df in (vectors.orderBy("row_index"), exemplars))
    routes, cos = [r["route"] for r in exemplars.collect()], (v @ e.T).round(12)
    monkeypatch.setattr(E, "PRODUCT_EXEMPLARS", 500)
    monkeypatch.setattr(E, "PRODUCT_STEP", 200)
    for least in (None, 0.5, 0.7):
        found = {r["row_index"]: (r["route"], round(r["score"], 9)) for r in E.best_routes(vectors, exemplars, bound=2, threshold=least).collect()}
        assert found == {i: (min(routes[j] for j in np.flatnonzero(c == c.max())), round(c.max(), 9)) for i, c in enumerate(cos) if least is None or c.max() >= least}
    packed = vectors.select(E._packed_unit(F.col("vector")).alias("u")).agg(F.avg(F.length("u.bits") + F.length("u.values"))).first()[0]
    assert packed < 0.15 * 8 * v.shape[1]
