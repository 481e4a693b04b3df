"""Line dedup by pairwise alignment: overlapping documents are found by shared rare lines and aligned by patience diff."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasize.llm.common import bounded_batches, free_names, id_or_null_id, written
from stratasize.operators.filters import numbered_by_ranges

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_SPACE = " \t\n\v\f\r"


#: Cells of a table of bits for a longest common subsequence; a larger one is halved first (Hirschberg).
_CELLS = 1 << 27


def common_subsequence(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of a[a0:a1] and b[b0:b1] without Nones, by rows of bits."""
    out, in_a, in_b = [], set(a[a0:a1]) - {None}, set(b[b0:b1]) - {None}
    todo = [([i for i in range(a0, a1) if a[i] in in_b and a[i] is not None], [j for j in range(b0, b1) if b[j] in in_a and b[j] is not None])]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if len(x) > 1 and len(x) * len(y) > _CELLS:
            half = len(x) // 2
            ahead = _lengths(_rows(a, b, x[:half], y, keep=False)[-1], len(y))
            back = _lengths(_rows(a, b, x[half:][::-1], y[::-1], keep=False)[-1], len(y))
            cut = max(range(len(y) + 1), key=lambda k: ahead[k] + back[len(y) - k])
            todo += [(x[:half], y[:cut]), (x[half:], y[cut:])]
            continue
        rows, j = _rows(a, b, x, y), len(y) - 1
        for i in range(len(x) - 1, -1, -1):
            # Zeros among a row's lowest bits count the longest common subsequence up to there.
            while j >= 0 and rows[i + 1] >> j & 1:
                j -= 1
            if j < 0:
                break
            if rows[i] >> j & 1:
                out.append((x[i], y[j]))
                j -= 1
    return out


def _rows(a: Sequence, b: Sequence, x: list[int], y: list[int], keep: bool = True) -> list[int]:
    """After each item of x, a number whose k-th bit is zero where y[:k + 1] has a longer common subsequence than y[:k]."""
    full, at = (1 << len(y)) - 1, {}
    for k, j in enumerate(y):
        at.setdefault(b[j], []).append(k)
    bits = {}
    for item, ks in at.items():
        place = bytearray(len(y) // 8 + 1)
        for k in ks:
            place[k >> 3] |= 1 << (k & 7)
        bits[item] = int.from_bytes(place, "little")
    row, rows = full, [full]
    for i in x:
        met = row & bits.get(a[i], 0)
        row = ((row + met) | (row - met)) & full
        if keep:
            rows.append(row)
        else:
            rows = [row]
    return rows


def _lengths(row: int, n: int) -> list[int]:
    """The length of the longest common subsequence with each prefix of y."""
    out = [0]
    for k in format(row | 1 << n, "b")[:0:-1]:
        out.append(out[-1] + (k == "0"))
    return out


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of equal items, ascending in both: common ends of a range match; then the longest ascending run of
    items that are once in either part anchors it, and the parts between anchors go on alike. A part without such items
    is aligned by a longest common subsequence. Items that are None (blank lines) match at ends but nowhere else.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        both = [(i, place[a[i]]) for i in range(a0, a1) if a[i] is not None and in_a[a[i]] == 1 and a[i] in place]
        if not both:
            out += common_subsequence(a, b, a0, a1, b0, b1)
            continue
        ends, at, before = [], [], [-1] * len(both)
        for n, (_, j) in enumerate(both):
            k = bisect_left(ends, j)
            before[n] = at[k - 1] if k else -1
            ends[k : k + 1], at[k : k + 1] = [j], [n]
        run, n = [], at[-1]
        while n >= 0:
            run.append(both[n])
            n = before[n]
        i0, j0 = a0, b0
        for i, j in [*run[::-1], (a1, b1)]:
            todo.append((i0, i, j0, j))
            if (i, j) != (a1, b1):
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _key(id_col: str, text_col: str) -> Column:
    """What orders documents: doc_id, then a hash of the text for rows that share an id."""
    return F.struct(id_or_null_id(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def line_hashes(text: Column) -> Column:
    """The MD5 of each trimmed line of a text, null for a blank line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _TRIM, ""))
    return F.transform(lines, lambda x: F.when(x != "", F.unhex(F.md5(x.cast("binary")))))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the later document's items that the alignment with an earlier one matches."""
    for batch in batches:
        gone = [[j for _, j in patience(a, b)] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["key", "at"])


def _aligned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, at): the items of each pair's later document that the alignment matches."""
    earlier, later = reps.select(F.col("key").alias("first"), F.col("items").alias("a")), reps.select("key", F.col("items").alias("b"))
    matched = pairs.join(earlier, "first").join(later, "key").select("key", "a", "b").mapInArrow(_align, "key struct<id:long,h:long>, at array<int>")
    return matched.select("key", F.explode("at").alias("at"))


def _shared_items(lines: DataFrame) -> DataFrame:
    """(key, c, places, items): of each document the lines that another one has as well, in order, where they stand, and
    a digest of their sequence."""
    each = lines.select("key", F.posexplode("lines").alias("place", "line")).where("line IS NOT NULL")
    held = lines.select(F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("line"))
    # A table of its own, so that the join below has two plain exchanges and Spark can split a hot line's holders.
    shared = written(held.groupBy("line").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("line"), "shared-lines")
    own = each.join(shared, "line", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("s"))  # a document's lines
    own = own.select("key", F.col("s.place").alias("places"), F.col("s.line").alias("items"))
    return own.select("key", F.sha2(F.array_join(F.transform("items", lambda x: F.hex(x)), ""), 256).alias("c"), "places", "items")


def _matched(reps: DataFrame, first_width: int = 1) -> DataFrame:
    """(key, at): the items of each representative that its alignment with any earlier one matches that has the item.

    An item's line has holders in the order of keys. Each open item is tried with its line's first holder; what stays
    open with the next ones, ever more at a time, until no item is open or none has an earlier holder left. A pair is
    aligned once. So the result is that of all pairs that share a line, at any number of holders, and the work is that
    of the pairs that it takes to find each item's match.
    """
    each = reps.select("key", F.posexplode("items").alias("at", "line"))
    holders = numbered_by_ranges(each.select("key", "line").distinct(), ["key"], ["line"], "nth")
    holders = written(holders, "line-holders")
    open_ = written(each.join(holders, ["key", "line"]).where("nth > 0"), "open-items")
    tried, found, low, width = None, [], 0, first_width
    while not open_.isEmpty():
        near = holders.where((F.col("nth") >= low) & (F.col("nth") < low + width)).select(F.col("key").alias("first"), "line", F.col("nth").alias("n"))
        pairs = open_.select("key", "line", "nth").distinct().join(near, "line").where("n < nth").select("first", "key").distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["first", "key"], "left_anti"), "line-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found.append(written(_aligned(pairs, reps), "matched-items"))
        low, width = low + width, max(8, 3 * (low + width))
        open_ = written(open_.where(F.col("nth") > low).join(found[-1].distinct(), ["key", "at"], "left_anti"), "open-items")
    return reduce(DataFrame.unionByName, found) if found else each.select("key", "at").limit(0)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, places): for each document with something to delete, the indices of its lines.

    Documents with one sequence of shared lines form a class with its first as representative. Every other document of
    the class goes with all its shared lines, as they are aligned with the representative's; representatives are aligned
    with earlier ones, which stand for their classes (_matched()).
    """
    lines = written(bounded_batches(docs).select(_key(id_col, text_col).alias("key"), line_hashes(F.col(text_col)).alias("lines")).where("lines IS NOT NULL").dropDuplicates(["key"]), "lines")
    own = written(_shared_items(lines), "shared-items")
    classes = written(own.groupBy("c").agg(F.min("key").alias("first")), "line-classes")
    classed = own.join(classes, "c")
    reps = written(classed.where("key = first").select("key", "places", "items"), "line-representatives")
    matched = _matched(reps).groupBy("key").agg(F.collect_set("at").alias("at"))  # a document's items
    told = reps.join(matched, "key").select("key", F.transform("at", lambda i: F.col("places")[i]).alias("places"))
    return told.unionByName(classed.where("key > first").select("key", "places"))


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("n_lines", T.IntegerType()).add("n_removed", T.IntegerType()))
def _cut(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), places.to_pylist(), strict=True):
        lines = text.split("\n") if text is not None else []
        gone = set(gone or ())
        if gone:  # blank lines go with the lines on both sides of them
            before, waiting = True, []
            for i, x in enumerate(lines):
                if not x.strip(_SPACE):
                    waiting.append(i)
                    continue
                if before and i in gone:
                    gone.update(waiting)
                before, waiting = i in gone, []
            if before:
                gone.update(waiting)
        left = [x for i, x in enumerate(lines) if i not in gone]
        kept = text if not gone else "\n".join(left) if any(x.strip(_SPACE) for x in left) else ""
        out.append((kept, len(lines), len(gone)))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["text", "n_lines", "n_removed"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines deleted that an earlier document has as well, and n_lines and n_removed.

    Lines are equal when identical without white space at their ends. Each two documents that share a line are aligned
    by their shared lines (a line that only one document has can't match), by patience(); the lines of the later one in
    the alignment go. One rule holds at any number of holders: results are those of all pairs, though only the pairs are
    aligned that it takes to find them (see _matched() and removals()). Documents are judged on the input, earlier is a
    smaller doc_id, and nothing is deleted for a repeat inside one document. Blank lines go with the lines on both sides
    of them; a text of which only blank lines are left becomes empty; the document stays.

    Work: documents of one sequence of shared lines are one in the alignments. A line that no alignment matches, because
    all its earlier holders have it in another order, is tried with all of them; there pairs can grow with its holders.
    Hot lines' holders are counted before they travel, numbered by ranges, and spread over tasks by skew-join splitting.

    Nulls: a null text has no lines and stays null; a null doc_id is earlier than all others. Rows that share an id
    with different texts are ordered by a hash of them; fully repeated rows are one document and get the same verdict.
    Empty and very long texts: as any other; a text's lines are aligned in one task. Empty table: empty result. Other
    columns pass through, except n_lines and n_removed, which are replaced.
    """
    key, places, cut = free_names(docs, "__key", "__places", "__cut")
    gone = removals(docs, id_col, text_col).select(F.col("key").alias(key), F.col("places").alias(places))
    found = docs.withColumn(key, _key(id_col, text_col)).join(gone, key, "left").withColumn(cut, _cut(F.col(text_col), F.col(places)))
    found = found.withColumns({text_col: F.col(f"{cut}.text"), "n_lines": F.col(f"{cut}.n_lines"), "n_removed": F.col(f"{cut}.n_removed")})
    return found.drop(key, places, cut)
