"""Repeated passages where rows share ids, against brute force over rows."""

import collections
import random

import numpy as np
import pytest
import xxhash

from stratasize.llm import substring_dedup


def kept(rows, window):
    """The words left of each row: documents are distinct (id, text) rows, null ids first, texts of one id by hash."""
    order = {r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).view(np.int64)) for r in set(rows)}
    seen, out = set(), {}
    for r in sorted(order, key=order.get):
        words = r[1].split()
        gone = set()
        for i in range(len(words) - window + 1):
            if (w := tuple(words[i : i + window])) in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[r] = [x for i, x in enumerate(words) if i not in gone]
    return [(r[0], len(r[1].split()) - len(out[r]), " ".join(out[r])) for r in rows]


def run(spark, rows, window):
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
    return collections.Counter((r["doc_id"], r["n_removed"], r["kept"]) for r in got)


@pytest.mark.parametrize("held", [32 << 20, 200])
def test_rows_that_share_ids(spark, monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", held)
    draw = random.Random(3)
    passage = [f"w{i}" for i in range(25)]
    text = lambda: " ".join(draw.choices("abcdefgh", k=draw.randrange(30)) + passage[: draw.choice([0, 20, 25])] + draw.choices("abcdefgh", k=draw.randrange(30)))
    rows = [(5, " ".join(passage))] * 2 + [(6, " ".join(passage[:22])), (6, "x " + " ".join(passage))]
    rows += [(draw.choice([None, 1, 2, 5, 7, 8]), text()) for _ in range(40)]
    rows += rows[10:20]
    assert run(spark, rows, 20) == collections.Counter(kept(rows, 20))
    assert run(spark, [(5, " ".join(passage))] * 2, 20) == {(5, 0, " ".join(passage)): 2}


def test_a_phrase_in_every_window(spark, monkeypatch):
    """Frequent words make frequent m-mers, with which all minimisers give way to others where there are any."""
    monkeypatch.setattr(substring_dedup, "FREQUENT", 1e-3)
    draw = random.Random(4)
    rows = [(i, " ".join("of all the" if k % 4 else draw.choice("pqrs") for k in range(60))) for i in range(40)]
    assert run(spark, rows, 20) == collections.Counter(kept(rows, 20))
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id long, h long, text string")
    assert len(substring_dedup.frequent_mers(docs, 1)) > 0
