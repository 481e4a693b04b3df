"""Repeated lines inside alignments, against brute force that doesn't use the patience diff."""

import hashlib
import random

import pytest

from line_oracle import plain_lines
from stratasize.llm import line_dedup, queries


def longest(a, b):
    """The length of the longest common subsequence, by the textbook table; blank lines don't count."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y and x is not None else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [1 << 27, 8, 1])
def test_common_subsequence_is_longest(monkeypatch, cells):
    monkeypatch.setattr(line_dedup, "_CELLS", cells)
    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.choice([None, "p", "q", "r", "s"]) for _ in range(draw.randrange(14))] for _ in range(2))
        pairs = sorted(line_dedup.common_subsequence(a, b, 0, len(a), 0, len(b)))
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] is not None for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


def test_repeated_lines_go_without_a_unique_anchor(spark):
    refrain = ["x", "la", "la", "y", "la", "z"]
    rows = [(1, "\n".join(["one", *refrain, "two"])), (2, "\n".join(["three", "la", "la", "four", "la", "five"]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "three\nfour\nfive" and got[1] == rows[0][1]


def kept(spark, rows):
    found = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return {r["doc_id"]: r["text"] for r in found.collect()}


def test_blocks_of_a_later_holder_go(spark):
    got = kept(spark, [(1, "x\na\ny"), (2, "y\nb\nx"), (3, "y\nc\nx")])
    assert got[3] == "c" and got[1] == "x\na\ny"


def test_one_rule_at_any_count(spark):
    """Documents 2 and 3 share lines, whoever else has them."""
    rows = [(1, "p1\np2\nu1"), (2, "p2\nv1\np1"), (3, "p2\nw1\np1")]
    for others in ([], [(i, f"p1\np2\nu{i}") for i in range(4, 74)], [(-i, f"n{i}\np1\np2\nu{i}") for i in range(1, 80)], [(-i, f"p1\nm{i % 9}\np2\nm{i % 7}") for i in range(1, 200)]):
        assert kept(spark, rows + others)[3] == "w1"
    rows = [(0, "h1\nh2"), (1, "r\na"), (2, "r\nh2\nb\nh1"), (3, "r\nh2\nc\nh1")]
    for others in ([], [(-i, f"h1\nh2\nu{i}") for i in range(1, 71)]):
        assert kept(spark, rows + others)[3] == "c"


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs_equal_brute_force(spark, seed):
    """Few lines in every order, own lines between them, blank lines, copies, and one line that all have."""
    draw = random.Random(seed)
    texts = []
    for i in range(90):
        own = [draw.choice([f"s{draw.randrange(3 + 4 * seed)}", f"own {i} {draw.randrange(50)}", "", " hot "]) for _ in range(draw.randrange(9))]
        texts.append("\n".join(own) if draw.random() < 0.8 or not texts else draw.choice(texts))
    assert list(dict(sorted(kept(spark, list(enumerate(texts))).items())).values()) == plain_lines(texts)


def test_given_documents_equal_brute_force(spark, small):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op5_line_dedup(spark, small).collect()}
    for (i, text), left in zip(rows, plain_lines([t for _, t in rows]), strict=True):
        n = 0 if left == text else len(text.split("\n")) - (len(left.split("\n")) if left else 0)
        assert got[i]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest() and got[i]["n_lines"] == len(text.split("\n"))
        assert got[i]["n_removed"] == n or not left
