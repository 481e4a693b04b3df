"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import bounded_batches, free_names, label_sample, slices

#: The label of a text that is null or has no letter.
UNDETERMINED = "und"
#: Bytes that the network reads at a stretch; its state starts anew in the next. Stretches that it reads side by side.
WINDOW, WIDTH = 96, 8192


@dataclass
class Direction:
    """A gated recurrent unit with piecewise linear gates; its inputs are bytes, so input weights are a table by byte."""

    table: np.ndarray  # (3 h, 256): update gate, reset gate, candidate
    recur: np.ndarray  # (3 h, h)


@dataclass
class Model:
    labels: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (labels, 2 h)
    bias: np.ndarray  # (labels, 1)

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.recur, self.backward.table, self.backward.recur, self.out, self.bias]


def new_model(labels: list[str], hidden: int, rng: np.random.Generator) -> Model:
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    one = lambda: Direction(normal(0.5, 3 * hidden, 256), normal(0.5 / np.sqrt(hidden), 3 * hidden, hidden))
    return Model(labels, one(), one(), normal(0.3, len(labels), 2 * hidden), np.zeros((len(labels), 1), np.float32))


def _states(d: Direction, steps: np.ndarray, there: np.ndarray | None) -> Iterator[np.ndarray]:
    """The state after each of the steps (rows of bytes), in the order given; where nothing is there, it stays zero."""
    hidden = d.recur.shape[1]
    h = np.zeros((hidden, steps.shape[1]), dtype=np.float32)
    table = d.table.copy()
    table[: 2 * hidden] = table[: 2 * hidden] * 0.25 + 0.5
    recur = d.recur.copy()
    recur[: 2 * hidden] *= 0.25
    given, wanted = np.empty((3 * hidden, steps.shape[1]), np.float32), np.empty((3 * hidden, steps.shape[1]), np.float32)
    for t, row in enumerate(steps):
        np.take(table, row, axis=1, out=given, mode="clip")
        np.matmul(recur, h, out=wanted)
        gates = given[: 2 * hidden]
        gates += wanted[: 2 * hidden]
        np.clip(gates, 0, 1, out=gates)
        n = wanted[2 * hidden :]
        n *= gates[hidden:]
        n += given[2 * hidden :]
        np.clip(n, -1, 1, out=n)
        h -= n
        h *= gates[:hidden]
        h += n
        if there is not None:
            h *= there[t]
        yield h


def position_scores(model: Model, steps: np.ndarray, there: np.ndarray | None) -> np.ndarray:
    """(positions, labels, stretches): each position's label probabilities from the states on both sides of it."""
    hidden = model.forward.recur.shape[1]
    out = np.empty((len(steps), len(model.labels), steps.shape[1]), dtype=np.float32)
    for t, h in enumerate(_states(model.forward, steps, there)):
        np.matmul(model.out[:, :hidden], h, out=out[t])
    for t, h in enumerate(_states(model.backward, steps[::-1], None if there is None else there[::-1])):
        out[-1 - t] += model.out[:, hidden:] @ h
    out += model.bias
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def document_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """(documents, labels): the mean of all positions' probabilities of each whole text; zeros for an empty one."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(offsets)
    if raw.null_count:
        size = np.where(np.asarray(raw.is_valid()), size, 0)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    pieces = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[:-1][owner] + nth * WINDOW
    length = np.minimum(WINDOW, size[owner] - nth * WINDOW)
    sums = np.zeros((len(size), len(model.labels)))
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), WIDTH):
        some = order[at : at + WIDTH]
        longest, shortest = int(length[some[0]]), int(length[some[-1]])
        place = np.arange(longest)[:, None]
        there = None if shortest == longest else (place < length[some]).astype(np.float32)
        steps = data[np.minimum(begin[some] + place, len(data) - 1)]
        scores = position_scores(model, steps, there)
        if there is not None:
            scores *= there[:, None, :]
        pooled = scores.sum(axis=0, dtype=np.float64)
        for k in range(len(model.labels)):
            sums[:, k] += np.bincount(owner[some], pooled[k], len(size))
    return sums / np.maximum(size, 1)[:, None]


def _gradient(model: Model, steps: np.ndarray, there: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradient by backpropagation through time."""
    hidden, n_steps, width = model.forward.recur.shape[1], *steps.shape
    sides = [(model.forward, steps, there, slice(0, hidden)), (model.backward, steps[::-1], there[::-1], slice(hidden, 2 * hidden))]
    kept, logits = [], np.zeros((n_steps, len(model.labels), width), np.float32) + model.bias
    for d, own, mask, cols in sides:
        h, past = np.zeros((hidden, width), np.float32), []
        for t in range(n_steps):
            a, g = d.table[:, own[t]], d.recur @ h
            gates = np.clip(0.25 * (a[: 2 * hidden] + g[: 2 * hidden]) + 0.5, 0, 1)
            z, r = gates[:hidden], gates[hidden:]
            n = np.clip(a[2 * hidden :] + r * g[2 * hidden :], -1, 1)
            new = (n + z * (h - n)) * mask[t]
            past.append((h, z, r, n, g[2 * hidden :], new))
            h = new
            logits[t if d is model.forward else n_steps - 1 - t] += model.out[:, cols] @ h
        kept.append(past)
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    total = there.sum()
    loss = float(-(np.log(p[:, label, np.arange(width)] + 1e-9) * there).sum() / total)
    p[:, label, np.arange(width)] -= 1
    p *= there[:, None, :] / total
    grads: list[np.ndarray] = []
    d_out = np.zeros_like(model.out)
    for (d, own, mask, cols), past in zip(sides, kept, strict=True):
        d_recur, d_h, d_in = np.zeros_like(d.recur), np.zeros((hidden, width), np.float32), np.empty((3 * hidden, n_steps, width), np.float32)
        for t in range(n_steps - 1, -1, -1):
            before, z, r, n, g_n, new = past[t]
            d_logit = p[t if d is model.forward else n_steps - 1 - t]
            d_out[:, cols] += d_logit @ new.T
            d_new = (d_h + model.out[:, cols].T @ d_logit) * mask[t]
            d_n = d_new * (1 - z) * (np.abs(n) < 1)
            d_z = 0.25 * d_new * (before - n) * ((z > 0) & (z < 1))
            d_r = 0.25 * d_n * g_n * ((r > 0) & (r < 1))
            d_g = np.concatenate([d_z, d_r, d_n * r])
            d_in[:, t] = np.concatenate([d_z, d_r, d_n])
            d_recur += d_g @ before.T
            d_h = d_new * z + d.recur.T @ d_g
        flat = own.ravel()
        d_table = np.stack([np.bincount(flat, row.ravel(), 256) for row in d_in]).astype(np.float32)
        grads += [d_table, d_recur]
    return loss, [*grads, d_out, p.sum(axis=(0, 2))[:, None]]


def train(windows: list[bytes], labels: list[str], hidden: int = 8, rounds: int = 250, batch: int = 256, rate: float = 0.02, seed: int = 1) -> Model:
    """Fits a network to stretches of text and their labels with Adam; each label is drawn equally often."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    model = new_model(names, hidden, rng)
    by_label = [np.flatnonzero(np.array(labels) == x) for x in names]
    padded = np.zeros((len(windows), WINDOW), np.uint8)
    size = np.array([len(w) for w in windows])
    for i, w in enumerate(windows):
        padded[i, : len(w)] = np.frombuffer(w, np.uint8)
    params = model.parameters()
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, rounds + 1):
        of = rng.integers(0, len(names), batch)
        rows = np.array([by_label[k][rng.integers(0, len(by_label[k]))] for k in of])
        there = (np.arange(WINDOW)[:, None] < size[rows]).astype(np.float32)
        _, grads = _gradient(model, padded[rows].T, there, of)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 3 * (1 - step / (rounds + 1)))
        for x, g, m, s in zip(params, grads, mean, square, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample_documents: int = 500, windows_per_document: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> Model | None:
    """A model of the labels in docs, from a bounded sample: at most sample_documents documents of each label, in the
    order of a hash of their id and text, and so many stretches of each at hashed places. Null labels and texts without
    a letter are not learned from. None if nothing is left.
    """
    rows = docs.where(F.col(label_col).isNotNull() & has_letter(text_col)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("h"))
    sample = label_sample(rows, sample_documents)
    if sample is None:
        return None
    place = lambda i: (F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int")
    cuts = F.array(*[F.substring("text", place(i), F.lit(WINDOW)) for i in range(windows_per_document)])
    found = sorted((r["h"], r["label"], r["cuts"]) for r in sample.select("h", "label", cuts.alias("cuts")).collect())
    windows, labels = [], []
    for _, label, own in found:
        windows += [w.encode()[:WINDOW] for w in own if w]
        labels += [label for w in own if w]
    return train(windows, labels, **options)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the label of the whole text with the highest pooled probability, and that probability.

    A text that is null or has no letter gets `und` and 0.0, as does every text when there is no model. Equal
    probabilities: the label first by name. Repeated rows get equal results; an empty table stays empty. The text is
    passed on with the other columns, which are not looked at.
    """
    if model is None:
        return docs.withColumns({label: F.lit(UNDETERMINED), score: F.lit(0.0)})

    @F.arrow_udf("label string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [document_scores(model, p.column(0)) for p in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0)] or [np.zeros((0, len(model.labels)))]
        scores = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array([model.labels[k] for k in scores.argmax(axis=1)], pa.string()), pa.array(np.minimum(scores.max(axis=1), 1.0) if len(scores) else np.zeros(0))], ["label", "score"])

    judged = F.when(has_letter(text_col), judge(F.when(has_letter(text_col), F.col(text_col))))
    (both,) = free_names(docs, "__judged")
    out = bounded_batches(docs).withColumn(both, judged)
    return out.withColumns({label: F.coalesce(f"{both}.label", F.lit(UNDETERMINED)), score: F.coalesce(f"{both}.score", F.lit(0.0))}).drop(both)
