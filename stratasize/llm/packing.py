"""Packing documents into sequences: first-fit decreasing on a tournament tree, in random groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import bounded_batches, slices
from stratasize.llm.tokens import DEFAULT_TOKENIZER, SLICE, encoder


class Bins:
    """Bins in a row; a tournament tree holds the largest free capacity below each node."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(n - 1, 0).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes size from the first bin with so much room and returns it."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bin_ = node - self.leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            top = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == top:
                break
            tree[node] = top
        return bin_


def pack_lengths(lengths: list[int], capacity: int, least_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each document's tokens once.

    A document's whole multiples of capacity are sequences of their own; first-fit decreasing packs the rests. Then the
    emptiest bins are taken apart to fill the gaps of at least least_cut in the fuller ones, and what is left of the last
    becomes sequences of powers of two.
    """
    out, rests = [], []
    for doc, n in enumerate(lengths):
        out += [[(doc, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rests.append((n % capacity, doc))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Bins(len(rests), capacity), []
    for size, doc in rests:
        b = tree.first_fit(size)
        if b == len(bins):
            bins.append([])
        bins[b].append((doc, lengths[doc] - size, size))
    room = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        if room[order[low]] < least_cut:
            low += 1
            continue
        gap, giver = room[order[low]], bins[order[high]]
        doc, at, size = giver.pop()
        moved = min(gap, size)
        bins[order[low]].append((doc, at, moved))
        room[order[low]] -= moved
        room[order[high]] += moved
        if moved < size:
            giver.append((doc, at + moved, size - moved))
        if not giver:
            high -= 1
    if order and room[order[high]] >= least_cut:
        out += _by_powers(bins[order[high]])
        high -= 1
    return out + [bins[b] for b in order[: high + 1] if bins[b]]


def _by_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    left, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while left:
        want = room = 1 << (left.bit_length() - 1)
        own = []
        while room:
            doc, at, size = pieces.pop()
            own.append((doc, at, min(size, room)))
            if size > room:
                pieces.append((doc, at + room, size - room))
            room -= min(size, room)
        out.append(own)
        left -= want
    return out


def _nth_of_equal(x: np.ndarray) -> np.ndarray:
    """How many values before each one in the order of a stable sort equal it."""
    order = np.argsort(x, kind="stable")
    ranked, out = x[order], np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.searchsorted(ranked, ranked)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str = DEFAULT_TOKENIZER,
    end_id: int = 2,
    capacity: int = 4096,
    group_documents: int = 2048,
    least_cut: int = 8,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece of a document in a sequence of at most capacity ids: doc_id, start (its document's ids
    before it), length, ids_crc32, doc_tokens, sequence_id, offset (in the sequence, without gaps), and ids if asked for.

    Documents are dealt at random (a hash of id and text) into groups of about so many, each packed alone by
    pack_lengths() in order of length, id and ids, so reruns agree and no group grows with the corpus; equal rows of a
    slice go to one group after the other. A group's padding is under least_cut ids a sequence; sequences of powers of two take its last rest.

    Nulls: a null text is empty, one end id; a null doc_id stays null. Repeated rows are packed each. A very long text is
    encoded whole, as a slice of its own.
    Empty table: empty result. Other columns are not read.
    """
    groups = max(1, -(-docs.count() // group_documents))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, end_id)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                ids, size = words.encode(part.column(2))
                pack = pa.array(np.mod(part.column(0).to_numpy() + _nth_of_equal(part.column(0).to_numpy()), groups))
                bounds = np.concatenate(([0], np.cumsum(size))) * ids.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pack, part.column(1), raw, pa.array(np.full(len(size), ids.itemsize, np.int32))], ["pack", "doc_id", "raw", "width"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def fill(group: pa.Table) -> pa.Table:
        rows = [(len(raw), -1 if i is None else i, raw, i) for i, raw in zip(group["doc_id"].to_pylist(), group["raw"].to_pylist(), strict=True)]
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        width, number = group["width"][0].as_py(), group["pack"][0].as_py()
        ids = [np.frombuffer(r[2], f"<u{width}").astype("<u4") for r in rows]
        out = []
        for nth, sequence in enumerate(pack_lengths([len(x) for x in ids], capacity, least_cut)):
            offset = 0
            for doc, start, length in sequence:
                own = ids[doc][start : start + length]
                out.append((rows[doc][3], start, length, zlib.crc32(own), len(ids[doc]), (number << 32) + nth, offset, *[own.astype(np.int32)] * with_ids))
                offset += length
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = bounded_batches(docs).select(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("h"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = dealt.mapInArrow(encode, "pack long, doc_id long, raw binary, width int")
    return encoded.groupBy("pack").applyInArrow(fill, ", ".join(f"{n} long" if n != "ids" else "ids array<int>" for n in names))
