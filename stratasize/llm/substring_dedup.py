"""Repeated passages by super-k-mer partitioning: windows that share a minimiser travel together and are counted by sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import Words, bounded_batches, id_or_null_id, mixed, null_id_to_null, powers, shuffle_partitions, slices

#: Words in the m-mers of which the least hash is a window's minimiser.
MINIMISER = 3
#: Windows in one super-k-mer at most; a longer stretch (one word again and again) goes on in the next.
LONGEST = 4096
#: Bytes of text for each bucket, and bytes of strings in a task from which equal ones are combined before more are read.
BUCKET_BYTES, HELD_BYTES = 4 << 20, 32 << 20
#: An m-mer that makes up this share of a sample of so many bytes is no minimiser where a window has another.
FREQUENT, SAMPLE_BYTES = 2e-5, 8 << 20
_PACKED = "bucket int, ids binary, starts binary, packed binary, gone binary"
#: What tells documents apart and orders them: doc_id, then a hash of the text for rows that share an id.
_DOC = np.dtype([("doc_id", "<i8"), ("h", "<i8")])
_GONE = np.dtype([("doc_id", "<i8"), ("h", "<i8"), ("start", "<i4"), ("end", "<i4")])
_BASE = 0xD1B54A32D192ED03


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values; combines runs of powers of two."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def _mers(words: Words) -> np.ndarray:
    h = words.hashes()
    out = np.zeros(max(len(h) - MINIMISER + 1, 0), dtype=np.uint64)
    for i in range(MINIMISER):
        out = out * np.uint64(_BASE) + h[i : len(h) - MINIMISER + 1 + i]
    return mixed(out)


def super_kmers(texts: pa.Array, window: int, frequent: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """words; first word, number of windows and minimiser of each maximal run of windows with one minimiser: the m-mer
    with the least hash, those that are frequent (sorted) after all others."""
    words = Words(texts)
    n = len(words.start)
    none = np.zeros(0, np.int64)
    if n < window:
        return words, none, none, none.astype(np.uint64)
    mers = _mers(words)
    order = mers >> np.uint64(1)
    if len(frequent):
        order |= (frequent[np.minimum(np.searchsorted(frequent, mers), len(frequent) - 1)] == mers).astype(np.uint64) << np.uint64(63)
    least = _sliding_min(order, window - MINIMISER + 1)
    doc = words.document()
    within = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(within)
    if not len(at):
        return words, none, none, none.astype(np.uint64)
    value = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + nth * LONGEST
        size = np.minimum(LONGEST, np.repeat(size, parts) - nth * LONGEST)
    return words, at[begin], size, value[begin]


def _first_of_equal(packed: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest occurrence of each distinct string, in order of (document, start); a mask of later ones.
    An occurrence at the same place of a fully repeated row is neither."""
    code = pa.array(packed, pa.binary()).dictionary_encode().indices.to_numpy()
    order = np.lexsort((starts, docs["h"], docs["doc_id"], code))
    new = np.ones(len(order), dtype=bool)
    new[1:] = code[order[1:]] != code[order[:-1]]
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (docs[order] != docs[leader]) | (starts[order] != starts[leader])
    first = order[new]
    return first[np.lexsort((starts[first], docs["h"][first], docs["doc_id"][first]))], later


def _spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(docs), dtype=_GONE)
    out["doc_id"], out["h"], out["start"], out["end"] = docs["doc_id"], docs["h"], starts, ends
    return out


def _documents(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    out = np.empty(len(ids), dtype=_DOC)
    out["doc_id"], out["h"] = ids.to_numpy(), hashes.to_numpy()
    return out


def frequent_mers(rows: DataFrame, total: int) -> np.ndarray:
    """Sorted hashes of the m-mers that are frequent in a hashed sample of rows (doc_id, h, text) of `total` bytes. Any
    set gives the same removals; this one keeps a common phrase from gathering its windows in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                words = Words(part.column(0))
                mer, n = np.unique(_mers(words), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(mer[n > 1].view(np.int64), 0)), pa.array(np.append(n[n > 1], 0)), pa.array(np.append(np.zeros((n > 1).sum(), np.int64), len(words.start)))], ["mer", "n", "words"])

    space = 1 << 20
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(space)) < max(1, min(space, space * SAMPLE_BYTES // max(total, 1)))).select("text")
    found = sample.mapInArrow(run, "mer long, n long, words long").groupBy("mer").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    # No more m-mers than 1 / FREQUENT can have that share, so the list is bounded.
    every = found.agg(F.sum("words")).first()[0] or 0
    return np.sort(np.array([r["mer"] for r in found.where(F.col("n") >= max(8, FREQUENT * every)).select("mer").collect()], np.int64).view(np.uint64))


def _packing(window: int, buckets: int, frequent: np.ndarray):
    """Cuts texts into super-k-mers, combines equal ones of a slice, and packs the rest by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, 2):
                words, first, size, value = super_kmers(part.column(2), window, frequent)
                if not len(first):
                    continue
                doc = np.searchsorted(words.first, first, side="right") - 1
                docs = _documents(part.column(0), part.column(1))[doc]
                starts = (first - words.first[doc]).astype(np.int32)
                data = words.data.tobytes()
                packed = [data[a:b] for a, b in zip(words.start[first].tolist(), words.end(first + size + window - 2).tolist(), strict=True)]
                bucket = (value % np.uint64(buckets)).astype(np.int64)
                keep, later = _first_of_equal(packed, docs, starts)
                gone = _spans(docs[later], starts[later], starts[later] + size[later] + window - 1)
                keep = keep[np.argsort(bucket[keep], kind="stable")]
                found, begin = np.unique(bucket[keep], return_index=True)
                rows = []
                for i, (b, own) in enumerate(zip(found.tolist(), np.split(keep, begin[1:]), strict=True)):
                    text = b"\n".join([packed[k] for k in own.tolist()])
                    rows.append((b, squeeze(docs[own].tobytes()), squeeze(starts[own].astype("<i4").tobytes()), squeeze(text), gone[i :: len(found)].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "ids", "starts", "packed", "gone"])

    return run


def repeated_windows(packed: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Spans of the words covered by windows that occur earlier, among all super-k-mers of some minimisers.

    Sorts window hashes, so equal windows meet in order of (document, start), and compares each with its first by content.
    """
    first, later = _first_of_equal(packed, docs, starts)
    unique = [packed[k] for k in first.tolist()]
    words = Words(pa.array([b"\n".join(unique)], pa.binary()))
    n = len(words.start)
    ends = np.cumsum(np.fromiter(map(len, unique), np.int64, len(unique)) + 1)
    owner = np.searchsorted(ends, words.start, side="right")
    counts = np.bincount(owner, minlength=len(unique))
    size_of = np.zeros(len(packed), np.int64)
    size_of[first] = counts
    code = {p: c for p, c in zip(unique, counts.tolist(), strict=True)} if later.any() else {}
    gone = [_spans(docs[later], starts[later], starts[later] + np.array([code[packed[k]] for k in np.flatnonzero(later).tolist()], np.int64))]
    h = words.hashes()
    power = powers(_BASE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * power, out=sums[1:])
    at = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    code64 = mixed((sums[at + window] - sums[at]) * powers(pow(_BASE, -1, 1 << 64), n)[at])
    del power, sums, h
    order = np.argsort(code64, kind="stable")  # at is in order of (document, start)
    ranked = code64[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if len(again):
        head = np.ones(len(order), dtype=bool)
        head[again] = False
        leader = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))[again]
        data = words.data.tobytes()
        x, y = at[order[again]], at[order[leader]]
        bounds = zip(words.start[x].tolist(), words.end(x + window - 1).tolist(), words.start[y].tolist(), words.end(y + window - 1).tolist(), strict=True)
        same = np.fromiter((data[a:b] == data[c:d] for a, b, c, d in bounds), bool, len(again))
        hit = x[same]
        if not same.all():  # unequal windows under one hash: tell all windows of that hash apart by content
            hit = np.append(hit, _told_apart(data, words, at[order], ranked, np.unique(ranked[again[~same]]), window))
        hit = np.unique(hit)
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(hit)))
        w = hit[begin]
        first_word = np.searchsorted(owner, np.arange(len(unique)))
        s = starts[first][owner[w]] + (w - first_word[owner[w]])
        gone.append(_spans(docs[first][owner[w]], s, s + size + window - 1))
    return np.concatenate(gone)


def _told_apart(data: bytes, words: Words, ordered: np.ndarray, ranked: np.ndarray, codes: np.ndarray, window: int) -> list[int]:
    hit = []
    for c in codes:
        seen = set()
        for w in ordered[np.searchsorted(ranked, c) : np.searchsorted(ranked, c, side="right")].tolist():
            content = data[words.start[w] : words.end(np.int64(w + window - 1))]
            if content in seen:
                hit.append(w)
            seen.add(content)
    return hit


def _counting(window: int):
    """Takes rows in order of bucket and judges the windows of one bucket at a time. Where a bucket's strings outgrow
    HELD_BYTES, equal ones are combined first, so that a task holds a bucket's distinct strings at most."""

    def batch_of(gone: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(gone[k])) for k in _GONE.names], list(_GONE.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        bucket, docs, starts, packed, held, most = None, [], [], [], 0, HELD_BYTES
        for row in _rows_and_end(batches):
            if packed and (row is None or row[0] != bucket):
                yield batch_of(repeated_windows(packed, np.concatenate(docs), np.concatenate(starts), window))
                docs, starts, packed, held, most = [], [], [], 0, HELD_BYTES
            if row is None:
                return
            bucket, text = row[0], loose(row[3])
            docs.append(np.frombuffer(loose(row[1]), _DOC))
            starts.append(np.frombuffer(loose(row[2]), "<i4").astype(np.int64))
            packed += text.split(b"\n")
            held += len(text)
            if row[4]:
                yield batch_of(np.frombuffer(row[4], _GONE))
            if held > most:
                of, at = np.concatenate(docs), np.concatenate(starts)
                first, later = _first_of_equal(packed, of, at)
                words = np.array([packed[k].count(b" ") + 1 for k in np.flatnonzero(later).tolist()], np.int64)
                yield batch_of(_spans(of[later], at[later], at[later] + words))
                docs, starts, packed = [of[first]], [at[first]], [packed[k] for k in first.tolist()]
                held = sum(map(len, packed))
                most = max(HELD_BYTES, 2 * held)

    return run


def _rows_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)
    yield None


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the words in each document's spans (starts, ends: word positions, in any order)."""
    for batch in batches:
        for part in slices(batch, 1):
            words = Words(part.column(1))
            data = words.data.tobytes()
            removed, texts = [], []
            for i, (a, b) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                low, high = int(words.first[i]), int(words.first[i + 1])
                if not a:
                    removed.append(0)
                    texts.append(data[words.start[low] : words.end(np.int64(high - 1))] if high > low else b"")
                    continue
                edge = np.zeros(high - low + 1, dtype=np.int64)
                np.add.at(edge, np.minimum(a, high - low), 1)
                np.add.at(edge, np.minimum(b, high - low), -1)
                keep = np.cumsum(edge)[:-1] == 0
                removed.append(int((~keep).sum()))
                turn = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
                texts.append(b" ".join([data[words.start[low + x] : words.end(np.int64(low + y - 1))] for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first)), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: the words left after each word went that lies in a window of so
    many words which starts earlier as well (in a smaller doc_id, or earlier in the document); kept joins them by spaces.

    Windows with one minimiser (the least hash of their m-mers, frequent ones last) that follow each other travel as one
    packed string to the minimiser's bucket; a slice's equal strings combine before that. Buckets follow the measured
    bytes of all texts; each is judged alone, and rows of a task come sorted by bucket, so a task holds the distinct
    strings of one bucket. Windows are judged on the input, by content.

    Nulls: a null text has no words; a null doc_id counts as smaller than all others. Rows that share a doc_id with
    different texts are documents in the order of a hash of the text; fully repeated rows are one document, which is no
    repeat of itself, and get the same verdict. A very long text is one slice, whole. Empty table or empty texts: no
    words. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(id_or_null_id(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * shuffle_partitions(spark), min(total // BUCKET_BYTES, (1 << 31) - 1))
    packed = rows.mapInArrow(_packing(window, buckets, frequent_mers(rows, total)), _PACKED)
    spans = packed.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_counting(window), "doc_id long, h long, start int, end int")
    spans = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    spans = spans.select("doc_id", "h", F.col("gone.start").alias("starts"), F.col("gone.end").alias("ends"))
    kept = rows.join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(_cutting, "doc_id long, n_words long, n_removed long, kept string")
    return kept.withColumn("doc_id", null_id_to_null("doc_id"))
