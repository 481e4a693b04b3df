"""Vector compression by parts: codebooks from Lloyd rounds in exact integers that compare only what moved."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import free_names, scratch, written

SCALE = 1024
#: Components as integers stay below this, and parts below _MOST_PART components, so that a squared distance is an
#: integer that a double holds exactly.
_BOUND, _MOST_PART = 1 << 20, 1 << 10
_ROWS_AT_ONCE = 8192


@dataclass(frozen=True)
class Codebooks:
    """For each part a matrix of integers, an entry a row."""

    entries: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of all components as decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row; the lowest index of equal distances. Exact: all terms
    are integers within a double's 53 bits."""
    b = book.astype(np.float64)
    own, index, least = (b * b).sum(1), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), _ROWS_AT_ONCE):
        some = x[at : at + _ROWS_AT_ONCE].astype(np.float64)
        d = own - 2.0 * (some @ b.T)
        best = d.argmin(1)
        index[at : at + len(some)] = best
        least[at : at + len(some)] = (d[np.arange(len(some)), best] + (some * some).sum(1)).astype(np.int64)
    return index, least


def reassigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, index: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest_entries() of rows whose nearest entries before the last change of the book are known.

    moved marks entries that changed. A row whose entry stayed keeps its exact distance to it, and no other entry that
    stayed can be nearer now, so it is compared with moved entries only; a row whose entry moved with all of them.
    """
    index, least = index.copy(), least.copy()
    whole = moved[index]
    if whole.any():
        index[whole], least[whole] = nearest_entries(x[whole], book)
    some, active = np.flatnonzero(~whole), np.flatnonzero(moved)
    if len(some) and len(active):
        to, d = nearest_entries(x[some], book[active])
        to = active[to]
        better = (d < least[some]) | ((d == least[some]) & (to < index[some]))
        index[some[better]], least[some[better]] = to[better], d[better]
    return index, least


def _matrix(values: pa.Array, width: int, kind: type) -> np.ndarray:
    """The lists of an array without nulls, each of one width, as a matrix."""
    return np.asarray(values.flatten()).astype(kind).reshape(len(values), width)


def _assign(books: Sequence[np.ndarray], moved: Sequence[np.ndarray] | None, ints: Column, index: Column, least: Column) -> Column:
    """A struct (index, least) of a row's parts; null where ints is null."""
    width = sum(b.shape[1] for b in books)

    @F.arrow_udf("struct<index:array<int>,least:array<bigint>>")
    def run(ints: pa.Array, index: pa.Array, least: pa.Array) -> pa.Array:
        there = np.flatnonzero(np.asarray(ints.is_valid()))
        x = _matrix(ints.drop_null(), width, np.int64)
        codes, dists, at = np.empty((len(x), len(books)), np.int32), np.empty((len(x), len(books)), np.int64), 0
        if moved is not None:
            old, known = _matrix(index.drop_null(), len(books), np.int64), _matrix(least.drop_null(), len(books), np.int64)
        for p, book in enumerate(books):
            part = x[:, at : at + book.shape[1]]
            codes[:, p], dists[:, p] = nearest_entries(part, book) if moved is None else reassigned(part, book, moved[p], old[:, p], known[:, p])
            at += book.shape[1]
        mask = np.ones(len(ints), bool)
        mask[there] = False
        offsets = np.concatenate([[0], np.cumsum(~mask) * len(books)]).astype(np.int32)
        gone = pa.array(mask)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()), mask=gone) for v in (codes, dists)]
        return pa.StructArray.from_arrays(lists, ["index", "least"], mask=gone)

    return run(ints, index, least)


def _sums(state: DataFrame, ints: str, index: str, parts: int, width: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows of each part and entry. Tasks add up their own rows first, so a task sends no more than
    the size of the codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, codes = _matrix(batch.column(0), parts * width, np.int64), _matrix(batch.column(1), parts, np.int64)
            for p in range(parts):
                own = np.argsort(codes[:, p], kind="stable")
                at, first = np.unique(codes[own, p], return_index=True)
                if len(at):
                    sums[p, at] += np.add.reduceat(x[own, p * width : (p + 1) * width], first, axis=0)
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        # Position -1 holds the count.
        values = np.concatenate([counts[p, e][:, None], sums[p, e]], axis=1)
        at = np.tile(np.arange(-1, width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width + 1), pa.int32()), pa.array(np.repeat(e, width + 1), pa.int32()), pa.array(at, pa.int32()), pa.array(values.ravel())], ["p", "e", "at", "s"])

    partial = state.where(F.col(index).isNotNull()).select(ints, index).mapInArrow(run, "p int, e int, at int, s long")
    found = partial.groupBy("p", "e", "at").agg(F.sum("s").alias("s")).toArrow()  # the size of the codebooks
    p, e, at, s = (np.asarray(found.column(c)) for c in ("p", "e", "at", "s"))
    sums = np.zeros((parts, entries, width + 1), np.int64)
    sums[p, e, at + 1] = s
    return sums[:, :, 1:], sums[:, :, 0]


def _usable(vector: str) -> Column:
    """Neither null nor with null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(vectors with codes instead of the vector, the codebooks). Adds code (an entry's index for each part, two hex digits
    each), error (squared distances of the parts to their entries, summed) and label_error (error over rows of one label).

    Components become floor(1024 * x); a vector is cut into equal parts. A part's book begins with that part of the rows
    with the smallest ids. In each round every part takes its nearest entry (of equal ones the lowest), then entries
    become the floored means of their parts; entries without parts stay. A last assignment follows.

    Active entries: rows keep their entries and exact distances from round to round in a written table; see reassigned().
    Sums are added up in tasks, then by Spark; only the codebooks' size reaches the driver and goes to the tasks. A round
    never moves rows: no shuffle but that of the sums.

    Rows with a null vector or null or non-finite components are left out. Rows that the books can't take (a length that
    isn't the most frequent one, or not a multiple of parts, or a component of 1024 or more) stay, with null code and
    error. Null ids come last, rows of one id are ordered by their integers, repeated rows count as often as they are
    there; null labels are one label. Fewer rows than entries give smaller books. Empty table: empty result and books.
    Other columns pass through, except code, error and label_error, which are replaced.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: from 1 to 256 entries")
    spark = vectors.sparkSession
    ints, index, least, found, total, label = free_names(vectors, "__ints", "__index", "__least", "__found", "__total", "__label")
    fits = F.forall(vector_col, lambda x: F.abs(x.cast("double")) < _BOUND / SCALE)
    whole = F.when(fits, F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))
    with scratch(spark) as keep:
        rows = written(vectors.where(_usable(vector_col)).withColumn(ints, whole).drop(vector_col), "vector-parts")
        lengths = rows.where(F.col(ints).isNotNull() & (F.size(ints) > 0) & (F.size(ints) % parts == 0)).groupBy(F.size(ints).alias("d")).count()
        top = lengths.orderBy(F.desc("count"), F.desc("d")).first()
        length = top["d"] if top else 0
        width = length // parts
        if width > _MOST_PART:
            raise ValueError(f"parts of more than {_MOST_PART} components have no exact distances in doubles")
        own = F.when(F.size(ints) == length, F.col(ints)) if length else F.lit(None).cast("array<int>")
        first = rows.where(F.size(ints) == length).orderBy(F.col(id_col).asc_nulls_last(), ints).limit(entries).select(ints).toArrow() if length else None
        seeds = _matrix(first.column(0).combine_chunks(), length, np.int64) if length else np.zeros((0, 0), np.int64)
        books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
        state, moved = rows.withColumns({ints: own, index: F.lit(None).cast("array<int>"), least: F.lit(None).cast("array<bigint>")}), None
        for nth in range(rounds + 1 if length else 0):
            done = state.withColumn(found, _assign(books, moved, F.col(ints), F.col(index), F.col(least)))
            done = done.withColumns({index: F.col(f"{found}.index"), least: F.col(f"{found}.least")}).drop(found)
            state = written(done, "assigned-parts")
            if nth == rounds:
                break
            sums, counts = _sums(state, ints, index, parts, width, len(seeds))
            new = [np.where(counts[p][:, None] > 0, sums[p] // np.maximum(counts[p], 1)[:, None], books[p]) for p in range(parts)]
            moved, books = [(n != b).any(1) for n, b in zip(new, books, strict=True)], new
        error = F.aggregate(least, F.lit(0).cast("long"), lambda s, x: s + x)
        code = F.array_join(F.transform(index, lambda i: F.lower(F.lpad(F.hex(i.cast("long")), 2, "0"))), "")
        coded = written(state.withColumns({"code": code, "error": error}).drop(ints, index, least), "codes")
        by_label = coded.groupBy(F.col(label_col).alias(label)).agg(F.sum("error").alias(total))
        out = coded.join(by_label, F.col(label_col).eqNullSafe(F.col(label))).withColumn("label_error", F.col(total)).drop(label, total)
        return keep(out, "vector-codes"), Codebooks(tuple(books))


def decoded(codes: DataFrame, books: Codebooks, code_col: str = "code", name: str = "approximation") -> DataFrame:
    """codes with the vector that each code stands for (the middle of its integers' cells); null for a null code."""

    @F.arrow_udf("array<double>")
    def run(codes: pa.Array) -> pa.Array:
        out = [None if c is None else np.concatenate([b[int(c[2 * p : 2 * p + 2], 16)] for p, b in enumerate(books.entries)]) for c in codes.to_pylist()]
        return pa.array([None if v is None else (v + 0.5) / SCALE for v in out], pa.list_(pa.float64()))

    return codes.withColumn(name, run(F.col(code_col)))
