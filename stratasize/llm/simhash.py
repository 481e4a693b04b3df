"""SimHash fingerprints, linked within a Hamming distance by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import NULL_ID, Words, bounded_batches, free_names, id_or_null_id, kept_rows, null_id_to_null, slices, written
from stratasize.llm.components import connected_components

#: 64 bits in four segments of 16; links at three differing bits or fewer.
BITS, SEGMENTS, DISTANCE = 64, 4, 3
_LANES = np.uint64(0x0101010101010101)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text as a long; a null doc_id is NULL_ID.

    A-Z are lower-cased; shingles of so many words, repeats included, are hashed with XXH64 (seed 42); a bit is set if
    it is set in over half of the hashes. Fewer words than width: their whole sequence is the one shingle. No word: 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_simhash(part.column(1), width).view(np.int64))], ["doc_id", "fp"])

    return bounded_batches(docs).select(id_or_null_id(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _simhash(texts: pa.Array, width: int) -> np.ndarray:
    words = Words(texts, lower=True)
    count = np.diff(words.first)
    shingles = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    total = int(shingles.sum())
    out = np.zeros(len(count), dtype=np.uint64)
    if not total:
        return out
    base = np.cumsum(shingles) - shingles
    first = np.repeat(words.first[:-1] - base, shingles) + np.arange(total)
    last = np.minimum(first + width, np.repeat(words.first[1:], shingles)) - 1
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], 42) for a, b in zip(words.start[first].tolist(), words.end(last).tolist(), strict=True)), dtype=np.uint64, count=total)
    # Counts of each bit, in byte lanes: stretches of at most 255 hashes of one document can't overflow a lane.
    pieces = -(-shingles // 255)
    owner = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    stretch = base[owner] + nth * 255
    used = np.flatnonzero(shingles)
    from_piece = (np.cumsum(pieces) - pieces)[used]
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, stretch).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), from_piece, axis=0)
        over = (2 * counts > shingles[used][:, None]).astype(np.uint64)
        for lane in range(8):
            out[used] |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def _ring_key(fp: F.Column, start: int) -> F.Column:
    """Two consecutive segments of the ring, the first of them the start-th, in the low 32 bits."""
    shift = 16 * start
    turned = fp if not shift else F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, BITS - shift))
    return F.shiftrightunsigned(turned, 32)


def _segment_difference(x: F.Column, first: int, n: int) -> F.Column:
    """Set bits of x in n consecutive segments of the ring from the first."""
    bits = 0
    for s in range(first, first + n):
        bits |= 0xFFFF << (16 * (SEGMENTS - 1 - s % SEGMENTS))
    return F.bit_count(x.bitwiseAND(F.lit(bits - (1 << BITS) if bits >> 63 else bits)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b, differing): the pairs of distinct fingerprints (column fp) that differ in at most DISTANCE bits, each once.

    Pigeonring: on the ring of four segments, two fingerprints within three bits have a start from which each chain of
    l segments differs in at most 3 l / 4 bits: the first segment in none, two in one, three in two, all in three.
    The chain of two is the index: one side goes to the key of its two segments, the other to that key and the 16
    with one bit of the second segment flipped, so a bucket shares 31 of 32 bits and work grows with the fingerprints.
    Longer chains and earlier starts are checked in the join, then the full difference. Fingerprints are distinct, so no
    row links to more than a Hamming ball's 43,744 others and no bucket holds more than its 2^32 remaining values.
    """
    keys = [(start, _ring_key(F.col("fp"), start)) for start in range(SEGMENTS)]
    tagged = lambda start, key: key.bitwiseOR(F.lit(start << 32))
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[tagged(s, k) for s, k in keys])).alias("key"))
    near = [tagged(s, k.bitwiseXOR(F.lit(flip))) for s, k in keys for flip in [0] + [1 << i for i in range(16)]]
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.array(*near)).alias("key"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    viable = lambda start: (_segment_difference(x, start, 1) == 0) & (_segment_difference(x, start, 2) <= 1) & (_segment_difference(x, start, 3) <= 2)
    start = F.shiftrightunsigned("key", 32)
    chain = F.lit(False)
    for s in range(SEGMENTS):
        earlier = F.lit(False)
        for t in range(s):
            earlier = earlier | viable(t)
        chain = chain | ((start == s) & viable(s) & ~earlier)
    pairs = probe.join(index, "key").where(F.col("a") < F.col("b")).where((F.bit_count(x) <= DISTANCE) & chain)
    return pairs.select("a", "b", F.bit_count(x).alias("differing"))


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs: the SimHash in hex, and the smallest doc_id that links reach.

    Rows of one fingerprint form one node, so a hot group of copies is a single row in the search and in the components.
    Nulls: a null text has no words (fingerprint zero, linked like any other); a null doc_id comes back as null, sorts
    before all ids, and a component that holds one has a null component_id. Repeated rows: one result row each.
    A very long text is a slice of its own, whole. Empty table: empty result. Other columns are neither read nor returned.
    """
    found = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    links = fingerprint_links(nodes.select("fp"))
    parts = written(connected_components(links), "fingerprint-components")
    of_fp = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = of_fp.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of_fp.join(least, "component").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.join(named, "fp").select(null_id_to_null("doc_id").alias("doc_id"), hexed, null_id_to_null("component_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: the one with the smallest doc_id, of those the one with
    the smallest fingerprint, and one of several that have both. Only the winners' ids are fingerprinted again, to tell
    rows that share an id apart."""
    found = written(near_duplicates(docs, width, id_col, text_col), "near-duplicates")
    won = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("fingerprint").alias("fingerprint"))
    id_, h = free_names(docs, "__id", "__h")
    mine = docs.withColumns({id_: id_or_null_id(id_col), h: F.xxhash64(text_col)})
    rows = mine.join(won.select(F.coalesce("component_id", F.lit(NULL_ID)).alias(id_)).distinct(), id_, "left_semi")
    told = fingerprints(rows, width, h, text_col).distinct().select(F.col("doc_id").alias("h"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))
    known = rows.select(F.col(id_).alias("id"), F.col(h).alias("h")).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).join(told, "h")
    kept = won.select(F.coalesce("component_id", F.lit(NULL_ID)).alias("id"), "fingerprint").join(known, ["id", "fingerprint"])
    one = kept.groupBy("id", "fingerprint").agg(F.min(F.struct("h", "n")).alias("b")).select("id", "b.h", "b.n")
    return kept_rows(docs, written(one, "near-winners"), {"id": id_or_null_id(id_col), "h": F.xxhash64(text_col)})
