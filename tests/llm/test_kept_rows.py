"""Rows, not ids, are kept and taken."""

import collections
import re

from stratasize.llm import mixing, typical
from stratasize.llm.exact_dedup import drop_copies, exact_dedup
from stratasize.llm.near_copies import drop_similar
from stratasize.llm.simhash import drop_near_copies

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_copies_by_row(spark):
    rows = [(3, "same", "a"), (5, "same", "b"), (5, "other", "c"), (7, "dup", "d"), (7, "dup", "d"), (None, "same", "e"), (None, "lone", "f"), (None, "lone", "f")] + [(None, "hot", "g")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc_id string")
    assert sorted(map(str, map(tuple, drop_copies(docs).collect()))) == sorted(map(str, [(3, "same", "a"), (5, "other", "c"), (7, "dup", "d"), (None, "lone", "f"), (None, "hot", "g")]))
    assert {r["group_size"] for r in exact_dedup(docs).where("keep_id IS NULL").collect()} == {2, 50}


def test_near_copies_by_row(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "to")
    rows = [(3, text), (5, other), (5, text + " more"), (7, "u v w x y z"), (7, "u v w x y z"), (None, other + " x"), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, h string, n int")
    kept = sorted(map(str, map(tuple, drop_similar(docs).select("doc_id", "text").collect())))
    assert kept in (sorted(map(str, [(3, text), (7, "u v w x y z"), (None, other + " x"), (9, t)])) for t in (None, "")) and drop_similar(docs).columns == docs.columns
    assert drop_similar(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(3, "a b c d"), (5, "q r s t"), (5, "a b c d"), (7, "a b c d"), (8, "m n"), (8, "m n")], "doc_id long, text string")
    assert sorted(map(tuple, drop_near_copies(twice).collect())) == [(3, "a b c d"), (5, "q r s t"), (8, "m n")]


def test_equal_rows_are_taken_each_as_their_number(spark):
    """What is delivered has as many words as are taken, whatever repeats."""
    rows = [(1, "a b c d e", "s")] * 4 + [(1, "v w x", "s"), (2, "a b c d e", "s"), (None, "n n", "s"), (None, "n n", "s"), (None, "m m m", None)] + [(None, "hot one", "t")] * 60 + [(5, None, "t"), (6, "", "s")]
    docs = spark.createDataFrame([(*r, i % 3, "x") for i, r in enumerate(rows)], "doc_id long, text string, source string, __copy int, repeats string").repartition(3)
    took = mixing.mix(docs).collect()
    assert len(took) == len(rows)
    want = collections.Counter()
    for r in took:
        want[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    targets = {r["source"]: int(r["target"] + 0.5) for r in took}
    assert want == targets
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    got = collections.Counter()
    for r in found.collect():
        got[r["source"]] += len(WORDS.findall(r["text"]))
    assert got == {k: v for k, v in want.items() if v}


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert typical.fit(docs) is None
    assert [r["doc_id"] for r in docs.where(typical.is_typical(None)).collect()] == [1]
