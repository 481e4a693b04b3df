"""The network's document scores against a plain pass a byte at a time, ties, and the bounded sample."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratasize.llm import language_id
from stratasize.llm.common import label_sample


def plain_scores(model, text):
    """Mean label probabilities of all positions; states start anew in each window."""
    data, total = text.encode(), np.zeros(len(model.labels))
    for at in range(0, len(data), language_id.WINDOW):
        window, sides = data[at : at + language_id.WINDOW], []
        for d, order in ((model.forward, window), (model.backward, window[::-1])):
            h, states, k = np.zeros(d.recur.shape[1]), [], d.recur.shape[1]
            for byte in order:
                a, g = d.table[:, byte].astype(float), d.recur.astype(float) @ h
                z, r = (np.clip(0.25 * (a[i * k : (i + 1) * k] + g[i * k : (i + 1) * k]) + 0.5, 0, 1) for i in (0, 1))
                n = np.clip(a[2 * k :] + r * g[2 * k :], -1, 1)
                h = n + z * (h - n)
                states.append(h)
            sides.append(states)
        for f, b in zip(sides[0], sides[1][::-1], strict=True):
            logit = model.out.astype(float) @ np.concatenate([f, b]) + model.bias[:, 0]
            e = np.exp(logit - logit.max())
            total += e / e.sum()
    return total / max(len(data), 1)


def test_scores_equal_a_plain_pass():
    model = language_id.new_model(["a", "b", "c"], 8, np.random.default_rng(7))
    texts = ["", "x", "a" * 95, "é" * 48, "word by word " * 40, "z" * 96 * 3 + "q"]
    got = language_id.document_scores(model, pa.array([*texts, None]))
    assert np.allclose(got[:-1], [plain_scores(model, t) for t in texts], atol=1e-4) and not got[-1].any()


def test_ties_go_to_the_first_label(spark):
    model = language_id.new_model(["a", "b"], 4, np.random.default_rng(7))
    model.out[:] = 0
    assert [tuple(r) for r in language_id.predict(spark.createDataFrame([("some text",)], "text string"), model).collect()] == [("some text", "a", 0.5)]


def test_the_sample_is_bounded_when_rows_repeat(spark):
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("label"), F.lit(5).cast("long").alias("h"))
    assert label_sample(rows, 30).groupBy("label").count().collect() == [("0", 30), ("1", 30)] or sorted(map(tuple, label_sample(rows, 30).groupBy("label").count().collect())) == [("0", 30), ("1", 30)]
    assert label_sample(rows.limit(0), 30) is None
