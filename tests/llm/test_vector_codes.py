import math

import numpy as np
import pytest

from stratasize.llm import queries
from stratasize.llm.vector_codes import compress, decoded, nearest_entries, reassigned


def plain(vectors, parts=4, entries=256, rounds=4):
    """Codes, errors and books of integer vectors in the order of their ids, all entries compared in every round."""
    x = np.array([[math.floor(1024 * float(v)) for v in row] for row in vectors], dtype=object)
    w = x.shape[1] // parts
    books = [[list(r[p * w : (p + 1) * w]) for r in x[:entries]] for p in range(parts)]
    for nth in range(rounds + 1):
        codes = []
        for row in x:
            one = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(row[p * w : (p + 1) * w], e)) for e in books[p]]
                one.append((min(d), d.index(min(d))))
            codes.append(one)
        if nth == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p * w : (p + 1) * w] for row, c in zip(x, codes) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own)]
    return ["".join(f"{i:02x}" for _, i in c) for c in codes], [sum(d for d, _ in c) for c in codes], books


@pytest.mark.parametrize(("entries", "spread"), [(4, 0.004), (6, 1.0), (256, 1.0)])
def test_codes_equal_brute_force(spark, entries, spread):
    rng = np.random.default_rng(entries)
    vectors = (rng.normal(size=(120, 8)) * spread).round(3).tolist()  # a small spread gives many ties
    rows = [(i, v, i % 3 if i % 5 else None, "x", "c") for i, v in enumerate(vectors)]
    found, books = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, __ints string, code string").repartition(3), entries=entries)
    codes, errors, want = plain([[np.float32(x) for x in v] for v in vectors], entries=entries)
    got = sorted(found.collect(), key=lambda r: r["vec_id"])
    assert [r["code"] for r in got] == codes and [r["error"] for r in got] == errors and [b.tolist() for b in books.entries] == want
    of = {}
    for (_, _, label, *_), e in zip(rows, errors):
        of[label] = of.get(label, 0) + e
    assert [r["label_error"] for r in got] == [of[r["label"]] for r in got] and got[0]["__ints"] == "x"


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, book = rng.integers(-4, 5, (60, 3)), rng.integers(-4, 5, (9, 3))
        index, least = nearest_entries(x, book)
        moved = rng.random(9) < 0.4
        new = np.where(moved[:, None], rng.integers(-4, 5, (9, 3)), book)
        a, b = reassigned(x, new, moved, index, least), nearest_entries(x, new)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, None, 1), (3, [nan] * 8, 1), (4, [inf] + [0.0] * 7, None), (5, [None] + [0.0] * 7, 2), (6, [1.0] * 6, 2), (7, [1e9] * 8, None), (8, [], 2), (None, [0.25] * 8, None), (9, [-0.1] * 8, 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, books = compress(vectors, entries=2)
    got = {(r["vec_id"], r["code"], r["error"] is None) for r in found.collect()}
    assert {g[0] for g in got} == {1, 6, 7, 8, 9, None} and found.count() == 7
    assert {g for g in got if g[0] in (6, 7, 8)} == {(6, None, True), (7, None, True), (8, None, True)}
    assert books.entries[0].shape == (2, 2)
    one = {r["vec_id"]: r["approximation"] for r in decoded(found, books).collect()}
    assert one[7] is None and len(one[9]) == 8
    empty, none = compress(vectors.limit(0))
    assert empty.count() == 0 and all(b.size == 0 for b in none.entries)
    with pytest.raises(ValueError):
        compress(vectors, entries=300)


def test_query(spark, small):
    rows = sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])[:40]
    codes, _, _ = plain([r["embedding"] for r in rows], entries=8, rounds=2)
    found, _ = compress(spark.createDataFrame(rows), entries=8, rounds=2)
    assert [r["code"] for r in sorted(found.collect(), key=lambda r: r["vec_id"])] == codes
    assert queries.op12_vector_codes(spark, small).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
