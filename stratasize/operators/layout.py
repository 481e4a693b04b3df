"""Layouts of machines in datastores: best-fit packing, isolation and tiers, balancing, and their figures."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from heapq import heappush, heapreplace
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.functions.tables import AVERAGE_OF_PEAK, DEFAULT_IOPS
from stratasize.operators.filters import has_measurements, numbered_by_ranges
from stratasize.operators.ratios import small
from stratasize.sources.sinks import stored

# Isolation, tiers, the budget that headroom is measured against, utilisation bands.
ISOLATE_MIB, ISOLATE_IOPS, HOT_IOPS, WARM_IOPS, HOT_MACHINES, HEADROOM_IOPS = 2.0 * 1024 * 1024, 5_000.0, 500.0, 100.0, 10, 100_000.0
HIGH_BAND, MIDDLE_BAND = 80.0, 60.0
#: Machines to a task that packs groups, about: more tasks than groups cost little.
MACHINES_A_TASK = 50_000
#: Columns of machines that the figures of datastores are made of.
_OF_MACHINES = ("required_mib", "peak_iops", "workload_key")


@dataclass(frozen=True)
class Constraints:
    """Limits of a datastore; usable space is what snapshots and growth leave of the raw one."""

    max_mib: float = 4.0 * 1024 * 1024
    max_machines: int = 25
    iops_budget: float = 100_000.0
    snapshot_share: float = 0.15
    growth_share: float = 0.20

    @property
    def usable_ratio(self) -> float:
        return (1 - self.snapshot_share) * (1 - self.growth_share)

    @property
    def usable_mib(self) -> float:
        return self.max_mib * self.usable_ratio


def with_default_iops(sized: DataFrame, iops: DataFrame, key: str = "workload_key") -> DataFrame:
    """sized with IOPS by workload (50 for others), and 70 % of it as the mean, if no machine at all was measured; else as it is."""
    table = small(iops.select(F.col("workload_key").alias("__k"), F.col("iops").alias("__iops")))
    measured = sized.agg(has_measurements().alias("__measured"))
    rows = sized.join(table, F.col(key) == F.col("__k"), "left").crossJoin(F.broadcast(measured))  # one row
    guess = F.coalesce("__iops", F.lit(DEFAULT_IOPS))
    keep = F.col("__measured") | (F.col("peak_iops") > 0)
    rows = rows.withColumns({"peak_iops": F.when(keep, F.col("peak_iops")).otherwise(guess), "avg_iops": F.when(keep, F.col("avg_iops")).otherwise(guess * AVERAGE_OF_PEAK)})
    return rows.drop("__k", "__iops", "__measured")


def oversized(c: Constraints) -> Column:
    return F.col("required_mib") > c.usable_mib


def _own_raw(c: Constraints) -> Column:
    return F.col("required_mib") / c.usable_ratio if c.usable_ratio > 0 else F.col("required_mib")


def _numbered(prefix: Column | str, n: Column) -> Column:
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("_"), F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))


def place_alone(vms: DataFrame, strategy: Column | str, prefix: Column | str, c: Constraints, groups: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Each machine in a datastore of its own size, numbered by prefix in row order; see numbered_by_ranges()."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = vms.select(*groups, as_column(strategy).alias("strategy"), "row_index", as_column(prefix).alias("__prefix"), _own_raw(c).alias("raw_mib"), F.col("required_mib").alias("usable_mib"), *keep)
    rows = numbered_by_ranges(rows, ["row_index"], [*groups, "strategy", "__prefix"], "__n")
    return rows.select(*groups, "strategy", "row_index", _numbered(F.col("__prefix"), F.col("__n") + 1).alias("datastore"), "raw_mib", "usable_mib", *keep)


class OpenBins:
    """Bins by used space, ascending, in blocks that know the least IOPS among theirs, so that a search passes over whole
    blocks without room. Of bins of equal space the one opened first comes last, since searches go from the end."""

    def __init__(self, block: int = 64):
        self.block, self.keys, self.busy = block, [[]], [[]]
        self.firsts, self.least = [(-1.0, 0)], [np.inf]

    def _at(self, key: tuple[float, int]) -> tuple[int, int]:
        i = max(bisect_right(self.firsts, key) - 1, 0)
        return i, bisect_left(self.keys[i], key)

    def add(self, used: float, busy: float, number: int) -> None:
        key = (used, -number)
        i, j = self._at(key)
        keys = self.keys[i]
        keys.insert(j, key)
        self.busy[i].insert(j, busy)
        if j == 0:
            self.firsts[i] = key
        if busy < self.least[i]:
            self.least[i] = busy
        if len(keys) > 2 * self.block:
            half = self.block
            self.keys.insert(i + 1, keys[half:])
            self.busy.insert(i + 1, self.busy[i][half:])
            del keys[half:], self.busy[i][half:]
            self.firsts.insert(i + 1, self.keys[i + 1][0])
            self.least.insert(i + 1, min(self.busy[i + 1]))
            self.least[i] = min(self.busy[i])

    def remove(self, used: float, number: int) -> None:
        self._out(*self._at((used, -number)))

    def fullest(self, space: float, iops: float, usable: float, budget: float) -> int | None:
        """The fullest bin that takes so much; of equal ones the first opened."""
        at = self._fullest(space, iops, usable, budget)
        return None if at is None else -self.keys[at[0]][at[1]][1]

    def take(self, space: float, iops: float, usable: float, budget: float) -> int | None:
        """fullest(), which is taken out."""
        at = self._fullest(space, iops, usable, budget)
        return None if at is None else self._out(*at)

    def _fullest(self, space: float, iops: float, usable: float, budget: float) -> tuple[int, int] | None:
        # A little beyond the space that is left, as sums are rounded; the test below is the exact one.
        start = bisect_right(self.firsts, ((usable - space) * (1 + 1e-9) + 1e-9, 1)) - 1
        for i in range(max(start, 0), -1, -1):
            if self.least[i] + iops > budget:
                continue
            keys, busy = self.keys[i], self.busy[i]
            for j in range(len(keys) - 1, -1, -1):
                if busy[j] + iops <= budget and keys[j][0] + space <= usable:
                    return i, j
        return None

    def _out(self, i: int, j: int) -> int:
        keys, busy = self.keys[i], self.busy[i]
        number, was = -keys.pop(j)[1], busy.pop(j)
        if not keys and len(self.keys) > 1:
            del self.keys[i], self.busy[i], self.firsts[i], self.least[i]
            return number
        if j == 0:
            self.firsts[i] = keys[0] if keys else (-1.0, 0)
        if was <= self.least[i]:  # only then can the least be another
            self.least[i] = min(busy, default=np.inf)
        return number


class BestFit:
    """Best fit of rows that come in its order, any number at a time: each into the fullest bin that takes its space, IOPS
    and count, or a new one. Of equal rows in a run the bin that took one takes the next as long as it can: it is the
    fullest still, as it was before. Only bins that may take more are held."""

    def __init__(self, usable: float, iops_budget: float, most: int):
        self.usable, self.iops_budget, self.most = usable, iops_budget, most
        self.open, self.held, self.opened = OpenBins(), {}, 0

    def take(self, space: np.ndarray, iops: np.ndarray) -> np.ndarray:
        """The bin of each row."""
        usable, budget, most, open_, held = self.usable, self.iops_budget, self.most, self.open, self.held
        differ = (space[1:] != space[:-1]) | (iops[1:] != iops[:-1]) | (space[1:] < 0)
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(space), 1), bool), differ]))
        bins, taken = [], []
        for own, load, left in zip(space[starts].tolist(), iops[starts].tolist(), np.diff(np.append(starts, len(space))).tolist(), strict=True):
            while left:
                b = open_.take(own, load, usable, budget)
                if b is None:
                    b, self.opened = self.opened, self.opened + 1
                u, w, n = held.pop(b, (0, 0, 0))
                u, w, n, took = u + own, w + load, n + 1, 1
                while took < left and n < most and u + own <= usable and w + load <= budget:
                    u, w, n, took = u + own, w + load, n + 1, took + 1
                if n < most and u == u and w == w:  # a bin of so many machines, or of an unknown sum, takes no more
                    held[b] = u, w, n
                    open_.add(u, w, b)
                bins.append(b)
                taken.append(took)
                left -= took
        return np.repeat(np.array(bins, np.int32), np.array(taken, np.int32))


class LeastLoaded:
    """Balancing of rows that come by their space, falling, any number at a time: each into the emptiest bin that has the
    space; if none has, a new one. A heap gives the emptiest bin, the first of equal ones."""

    def __init__(self, bins: int, usable: float):
        self.usable, self.heap, self.opened = usable, [(0.0, b) for b in range(bins)], bins

    def take(self, space: np.ndarray, iops: np.ndarray) -> np.ndarray:
        """The bin of each row."""
        usable, heap, out = self.usable, self.heap, []
        for own in space.tolist():
            used, b = heap[0]
            if used + own <= usable:
                heapreplace(heap, (used + own, b))
            else:
                b, self.opened = self.opened, self.opened + 1
                if own == own:
                    heappush(heap, (own, b))
            out.append(b)
        return np.array(out, np.int32)


def best_fit(rows: Mapping[str, np.ndarray], usable: float, iops_budget: float, most: int) -> list[int]:
    """The bin of each row: rows by the larger of their shares of space and IOPS, falling, go to BestFit. Ties keep the
    row order."""
    space, iops = np.asarray(rows["required_mib"], float), np.asarray(rows["peak_iops"], float)
    share = np.fmax(space / usable if usable > 0 else space * 0, iops / iops_budget if iops_budget > 0 else iops * 0)
    order, out = np.argsort(-share, kind="stable"), np.empty(len(space), int)
    out[order] = BestFit(usable, iops_budget, most).take(space[order], iops[order])
    return out.tolist()


def least_loaded(rows: Mapping[str, np.ndarray], usable: float, iops_budget: float, most: int) -> list[int]:
    """The bin of each row: rows by space, falling, go to LeastLoaded, with as many bins as space or IOPS need."""
    space, iops = np.asarray(rows["required_mib"], float), np.asarray(rows["peak_iops"], float)
    need = lambda total, each: ceil(total / each) if each > 0 else 1
    order, out = np.argsort(-space, kind="stable"), np.empty(len(space), int)
    out[order] = LeastLoaded(max(need(space.sum(), usable), need(iops.sum(), iops_budget), 1), usable).take(space[order], iops[order])
    return out.tolist()


#: How a label's machines are packed: its function, and whether a group dealt to parts has its emptiest bins packed again.
_RULES: dict[str, tuple[Callable, bool]] = {"best": (best_fit, True), "level": (least_loaded, False)}


def _packed(rows: pa.Table, c: Constraints, part_machines: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """rows of one group, strategy, label and part in their order, each one's bin, and whether it goes back, as it is in
    one of the part's emptiest bins."""
    rows = rows.take(pa.array(np.argsort(rows["row_index"].to_numpy(), kind="stable")))
    one = {x: rows[x][0].as_py() for x in ("rule", "most", "parts")}
    values, (pack, repack) = {x: rows[x].to_numpy() for x in ("required_mib", "peak_iops")}, _RULES[one["rule"]]
    bins = np.array(pack(values, c.usable_mib, c.iops_budget, one["most"]), np.int32)
    again = np.zeros(len(bins), bool)
    if repack and one["parts"] > 1:
        # The emptiest bins, by the largest of their shares, up to a part's share of one task's machines.
        share = np.max([np.bincount(bins, values[v]) / each for v, each in (("required_mib", c.usable_mib), ("peak_iops", c.iops_budget))] + [np.bincount(bins) / one["most"]], axis=0)
        order = np.argsort(share, kind="stable")
        within = np.cumsum(np.bincount(bins)[order]) <= max(part_machines // one["parts"], one["most"])
        again = np.isin(bins, order[within])
    return rows, bins, again


def _machines_of(rows: pa.Table, c: Constraints, part_machines: int) -> pa.Table:
    rows, bins, again = _packed(rows, c, part_machines)
    return rows.append_column("bin", pa.array(bins)).append_column("again", pa.array(again))


#: What a bin gives, once its machines were summed where they are packed.
_OF_BINS = "bin int, used_mib double, total_iops double, vm_count long, workloads array<string>"


def _bins_of(rows: pa.Table, c: Constraints, part_machines: int) -> pa.Table:
    """The sums of the bins that stay, and the machines of those that go back (with a null bin)."""
    rows, bins, again = _packed(rows, c, part_machines)
    one, back, stay, bins = rows.slice(0, 1), rows.filter(pa.array(again)), rows.filter(pa.array(~again)), bins[~again].astype(np.int64)
    known, at = np.unique(bins, return_inverse=True)

    def total(column: str) -> pa.Array:  # nulls add nothing; of nulls alone the sum is null
        valid = stay[column].is_valid().to_numpy()
        sums = np.bincount(at[valid], stay[column].to_numpy()[valid], minlength=len(known))
        return pa.array(sums, pa.float64(), mask=np.bincount(at[valid], minlength=len(known)) == 0)

    names = pa.array(sorted(x for x in stay["workload_key"].unique().to_pylist() if x is not None), pa.string())
    codes, kinds = pc.index_in(stay["workload_key"], names).fill_null(-1).to_numpy(), max(len(names), 1)
    pairs = np.unique((at * kinds + codes)[codes >= 0])
    starts = np.searchsorted(pairs, np.arange(len(known) + 1) * kinds)
    workloads = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), names.take(pa.array(pairs % kinds)))
    sums = {x: pa.array([one[x][0].as_py()] * len(known), one.schema.field(x).type) for x in ("group", "part", "parts")}
    sums |= {"bin": pa.array(known, pa.int32()), "used_mib": total("required_mib"), "total_iops": total("own_peak_iops"), "vm_count": pa.array(np.bincount(at, minlength=len(known)), pa.int64()), "workloads": workloads}
    return pa.concat_tables([back, pa.table(sums)], promote_options="default")


def _batches_packed(batches: Iterator[pa.RecordBatch], c: Constraints) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]], np.ndarray]]:
    """Each batch of rows in order, where its groups begin and end, and each row's bin. A group goes on from batch to
    batch: what is held of it is its open bins."""
    last, packer = None, None
    for batch in batches:
        group, space, iops = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("group", "required_mib", "peak_iops"))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist() if len(group) else []
        runs, bins = list(zip(edges, edges[1:], strict=False)), np.empty(len(group), np.int32)
        for begin, end in runs:
            if packer is None or group[begin] != last:
                last, most, opened = group[begin], batch.column("most")[begin].as_py(), batch.column("opened")[begin].as_py()
                packer = LeastLoaded(opened, c.usable_mib) if opened else BestFit(c.usable_mib, c.iops_budget, most)
            bins[begin:end] = packer.take(space[begin:end], iops[begin:end])
        yield batch, runs, bins


def _machines_in_order(batches: Iterator[pa.RecordBatch], c: Constraints) -> Iterator[pa.RecordBatch]:
    for batch, _, bins in _batches_packed(batches, c):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins)], [*batch.schema.names, "bin"])


class _BinSums:
    """The sums of a group's bins, while its rows come."""

    def __init__(self, group: int):
        self.group, self.sums, self.names, self.pairs, self.fresh = group, np.zeros((5, 64)), {}, np.zeros(0, np.int64), []

    def add(self, rows: pa.RecordBatch, bins: np.ndarray) -> None:
        if (n := int(bins.max()) + 1) > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros((5, max(n, 2 * self.sums.shape[1]) - self.sums.shape[1]))], 1)
        for at, x in ((0, "required_mib"), (2, "own_peak_iops")):
            valid = rows.column(x).is_valid().to_numpy(zero_copy_only=False)
            np.add.at(self.sums[at], bins[valid], rows.column(x).to_numpy(zero_copy_only=False)[valid])
            np.add.at(self.sums[at + 1], bins[valid], 1)
        np.add.at(self.sums[4], bins, 1)
        keys = rows.column("workload_key").dictionary_encode()
        codes = np.array([self.names.setdefault(x, len(self.names)) for x in keys.dictionary.to_pylist()] or [0], np.int64)
        valid = keys.indices.is_valid().to_numpy(zero_copy_only=False)
        own = codes[keys.indices.fill_null(0).to_numpy()][valid]
        self.fresh.append(np.unique(own << 32 | bins[valid].astype(np.int64)))
        if sum(map(len, self.fresh)) > len(self.pairs) + 100_000:  # a bin's workloads once
            self.pairs, self.fresh = np.unique(np.concatenate([self.pairs, *self.fresh])), []

    def batches(self) -> list[pa.RecordBatch]:
        used, with_used, iops, with_iops, count = self.sums
        known = np.flatnonzero(count)
        names = sorted(self.names)
        rank = np.zeros(max(len(names), 1), np.int64)
        rank[[self.names[x] for x in names]] = np.arange(len(names))
        pairs, kinds = np.concatenate([self.pairs, *self.fresh]), max(len(names), 1)
        pairs = np.unique(np.searchsorted(known, pairs & 0xFFFFFFFF) * kinds + rank[pairs >> 32])
        starts = np.searchsorted(pairs, np.arange(len(known) + 1) * kinds)
        workloads = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(names, pa.string()).take(pa.array(pairs % kinds)))
        total = lambda sums, n: pa.array(sums[known], pa.float64(), mask=n[known] == 0)  # noqa: E731 - of nulls alone the sum is null
        columns = {"group": pa.array(np.full(len(known), self.group, np.int64)), "bin": pa.array(known, pa.int32()), "used_mib": total(used, with_used), "total_iops": total(iops, with_iops), "vm_count": pa.array(count[known].astype(np.int64)), "workloads": workloads}
        return pa.table(columns).to_batches(max_chunksize=10_000)


def _bins_in_order(batches: Iterator[pa.RecordBatch], c: Constraints) -> Iterator[pa.RecordBatch]:
    held = None
    for batch, runs, bins in _batches_packed(batches, c):
        group = batch.column("group")
        for begin, end in runs:
            if held is None or held.group != group[begin].as_py():
                if held:
                    yield from held.batches()
                held = _BinSums(group[begin].as_py())
            held.add(batch.slice(begin, end - begin), bins[begin:end])
    if held:
        yield from held.batches()


def _in_order(planned: DataFrame, c: Constraints, groups: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """planned's machines that don't stand alone, in the order in which their group takes them, all of a group in one task;
    and what the groups' numbers stand for. Spark sorts them, on disk if need be."""
    share = lambda x, each: F.col(x) / each if each > 0 else F.col(x) * 0
    plain = lambda x: F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias(x)
    need = lambda x, each: F.ceil(F.sum(x) / each) if each > 0 else F.lit(1)
    keys, level = [*groups, "strategy", "label", "rule", "most"], F.col("rule") == "level"
    rest = planned.where("NOT alone").select(*keys, F.col("row_index").cast("long").alias("row_index"), plain("required_mib"), plain("peak_iops"), *keep)
    opened = F.greatest(need("required_mib", c.usable_mib), need("peak_iops", c.iops_budget), F.lit(1))
    sizes = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("machines"), F.when(level, opened).otherwise(0).cast("int").alias("opened"))
    rest, sizes, tasks = _numbered_groups(rest, sizes, keys)
    by = F.when(level, F.col("required_mib")).otherwise(F.greatest(share("required_mib", c.usable_mib), share("peak_iops", c.iops_budget)))
    rest = rest.select("group", by.alias("by"), "row_index", "required_mib", "peak_iops", "most", "opened", *keep)
    return rest.repartition(tasks, "group").sortWithinPartitions("group", F.desc_nulls_last("by"), "row_index").drop("by"), sizes


def _numbered_groups(rest: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """rest with the number and other columns of its group in sizes; what the numbers stand for; and how many tasks shall
    pack them. A group's number stands for its texts in the shuffle, the sort and Python."""
    sizes = stored(sizes.withColumn("group", F.monotonically_increasing_id()).withColumnsRenamed({k: f"__{k}" for k in keys}), "group-sizes")
    machines = sizes.agg(F.coalesce(F.sum("machines"), F.lit(0)).alias("n")).first()["n"]
    sizes, met = small(sizes.drop("machines")), F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # A number of tasks by machines: few bytes are much work here, so that tasks joined by their bytes would be few.
    return rest.join(sizes, met), sizes, max(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-machines // MACHINES_A_TASK))


def _grouped(planned: DataFrame, c: Constraints, groups: Sequence[str], part_machines: int, keep: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """planned's machines that don't stand alone, with the number of their group and their part; what the numbers stand
    for; and how many tasks shall pack them."""
    keys = [*groups, "strategy", "label", "rule", "most"]  # the last two are the label's
    rest = planned.where("NOT alone").drop("alone")
    sizes = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("machines")).withColumn("parts", F.ceil(F.col("machines") / part_machines).cast("int"))
    rest, sizes, tasks = _numbered_groups(rest, sizes, keys)
    rest = rest.withColumn("part", F.pmod(F.xxhash64("row_index"), F.col("parts")).cast("int"))
    return rest.select("group", "part", *[F.col(x).cast(t).alias(x) for x, t in (("row_index", "long"), ("required_mib", "double"), ("peak_iops", "double"))], "rule", "most", "parts", *keep), sizes, tasks


def _in_two_passes(rest: DataFrame, tasks: int, pack: Callable[[pa.Table], pa.Table], kinds: str, back: str) -> DataFrame:
    """What pack gives of each group and part; its rows that fulfil `back` are a part of their own and packed once more."""
    packed = stored(rest.repartition(tasks, "group", "part").groupBy("group", "part").applyInArrow(pack, kinds), "packed")
    # Only groups that were split have machines here; the second pass takes each as it is.
    second = packed.where(back).withColumns({"parts": F.lit(1), "part": F.lit(-1)}).select(rest.columns)
    second = second.repartition(tasks, "group").groupBy("group").applyInArrow(pack, kinds)
    return packed.where(f"NOT ({back})").unionByName(second)


def _named(found: DataFrame, sizes: DataFrame) -> tuple[DataFrame, Column]:
    """found with what its groups' numbers stand for, and the datastore's name."""
    found = found.drop("rule", "most", "parts", "opened").join(sizes, "group").withColumnsRenamed({x: x[2:] for x in sizes.columns if x.startswith("__")})
    if "part" not in found.columns:
        return found, _numbered(F.col("label"), F.col("bin") + 1).alias("datastore")
    prefix = F.when(F.col("part") < 0, F.concat("label", F.lit("_r"))).when(F.col("parts") > 1, F.concat("label", F.lit("_p"), F.col("part").cast("string"))).otherwise(F.col("label"))
    return found, _numbered(prefix, F.col("bin") + 1).alias("datastore")


def place(planned: DataFrame, c: Constraints, groups: Sequence[str] = (), part_machines: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The placement of planned machines: `alone` ones in datastores of their own, the others packed within their group
    (columns `groups`: an inventory, a cluster), strategy and label, all groups, strategies and labels in one pass.

    planned: groups, row_index, required_mib, peak_iops, strategy, label (the datastores' prefix), alone, rule, and most
    (machines of a datastore). Every group is packed exactly, whatever its size: a greedy takes one machine after the
    other, so a group is one task's, but it comes sorted and batch by batch, and only its open bins are held. With
    part_machines, which a caller may ask for, a larger group is dealt by a hash to parts that are packed alone; then the
    parts' emptiest bins (which a greedy leaves at its end, few a part) are packed once more, together. `packing` says
    `alone`, `exact` or `split`; parts' datastores have names like <label>_p<part>_<nn>, and those packed again
    <label>_r_<nn>. keep: columns that stay with a machine.
    """
    alone = place_alone(planned.where("alone"), F.col("strategy"), F.col("label"), c, groups, keep).withColumn("packing", F.lit("alone"))
    if part_machines is None:
        rest, sizes = _in_order(planned, c, groups, keep)
        kinds = ", ".join(f"`{x}` {t}" for x, t in rest.dtypes) + ", bin int"
        (found, name), kind = _named(rest.mapInArrow(lambda batches: _machines_in_order(batches, c), kinds), sizes), F.lit("exact")
    else:
        rest, sizes, tasks = _grouped(planned, c, groups, part_machines, keep)
        kinds = ", ".join(f"`{x}` {t}" for x, t in rest.dtypes) + ", bin int, again boolean"
        found, name = _named(_in_two_passes(rest, tasks, lambda rows: _machines_of(rows, c, part_machines), kinds, "again"), sizes)
        kind = F.when(F.col("parts") > 1, "split").otherwise("exact")
    return found.select(*groups, "strategy", "row_index", name, F.lit(c.max_mib).alias("raw_mib"), F.lit(c.usable_mib).alias("usable_mib"), kind.alias("packing"), *keep).unionByName(alone)


def place_in_stores(planned: DataFrame, c: Constraints, groups: Sequence[str] = (), part_machines: int | None = None) -> DataFrame:
    """The datastores of place(), as datastores() gives them, where its machines aren't asked for: all of a bin's machines
    are in the task that packs it, which sums them, so that machines travel once and no name is grouped by.

    planned: as place() takes it, with own_peak_iops, which are summed, and workload_key. A label has one rule and most."""
    alone = place_alone(planned.where("alone"), F.col("strategy"), F.col("label"), c, groups, ["own_peak_iops", "workload_key"])
    one = F.array_compact(F.array("workload_key"))
    alone = alone.select(*groups, "strategy", "datastore", "raw_mib", "usable_mib", F.col("usable_mib").alias("used_mib"), F.col("own_peak_iops").alias("total_iops"), F.lit(1).cast("long").alias("vm_count"), one.alias("workloads"))
    if part_machines is None:
        rest, sizes = _in_order(planned, c, groups, ["own_peak_iops", "workload_key"])
        found, name = _named(rest.mapInArrow(lambda batches: _bins_in_order(batches, c), f"group long, {_OF_BINS}"), sizes)
    else:
        rest, sizes, tasks = _grouped(planned, c, groups, part_machines, ["own_peak_iops", "workload_key"])
        kinds = ", ".join(f"`{x}` {t}" for x, t in rest.dtypes) + f", {_OF_BINS}"
        found, name = _named(_in_two_passes(rest, tasks, lambda rows: _bins_of(rows, c, part_machines), kinds, "bin IS NULL"), sizes)
    return _with_use(found.select(*groups, "strategy", name, F.lit(c.max_mib).alias("raw_mib"), F.lit(c.usable_mib).alias("usable_mib"), "used_mib", "total_iops", "vm_count", "workloads").unionByName(alone))


def isolated() -> Column:
    """Whether a machine gets a datastore of its own: a critical application, much space or many IOPS."""
    key = F.col("workload_key")
    return key.contains("SAP HANA") | key.contains("Exchange") | (F.col("required_mib") > ISOLATE_MIB) | (F.col("peak_iops") > ISOLATE_IOPS)


def isolation_prefix() -> Column:
    key = F.col("workload_key")
    return F.when(key.contains("HANA"), "DS_HANA").when(key.contains("Exchange"), "DS_EXCHANGE").when(key.contains("Oracle"), "DS_ORA").otherwise("DS_ISOLATED")


def tier() -> Column:
    return F.when((F.col("peak_iops") > HOT_IOPS) | F.col("workload_key").startswith("Database"), "HOT").when(F.col("peak_iops") >= WARM_IOPS, "WARM").otherwise("COLD")


def planned(vms: DataFrame, c: Constraints, groups: Sequence[str] = (), strategies: Sequence[str] = ("consolidation", "performance", "uniform"), keep: Sequence[str] = ()) -> DataFrame:
    """vms once for each strategy, with what place() needs. Consolidation packs all by best fit; performance isolates some
    machines and packs each tier alone, hot datastores holding ten machines at most; uniform balances. Machines beyond
    the usable space stand alone as <label>_OVER_nn."""
    one = lambda strategy, label, alone, rule, most: F.struct(F.lit(strategy).alias("strategy"), label.alias("label"), alone.alias("alone"), F.lit(rule).alias("rule"), most.cast("int").alias("most"))
    over = lambda label: F.when(oversized(c), F.concat(label, F.lit("_OVER"))).otherwise(label)
    any_, hot = F.lit(c.max_machines), F.when(tier() == "HOT", HOT_MACHINES).otherwise(c.max_machines)
    known = {
        "consolidation": one("consolidation", over(F.lit("DS_CONSOL")), oversized(c), "best", any_),
        "performance": one("performance", F.when(isolated(), isolation_prefix()).otherwise(over(F.concat(F.lit("DS_"), tier()))), isolated() | oversized(c), "best", hot),
        "uniform": one("uniform", over(F.lit("DS_UNIFORM")), oversized(c), "level", any_),
    }
    return vms.select(*groups, "row_index", "required_mib", "peak_iops", *keep, F.explode(F.array(*[known[s] for s in strategies])).alias("p")).select(*groups, "row_index", "required_mib", "peak_iops", *keep, "p.*")


def consolidation(vms: DataFrame, c: Constraints, groups: Sequence[str] = (), part_machines: int | None = None) -> DataFrame:
    return place(planned(vms, c, groups, ["consolidation"]), c, groups, part_machines)


def performance(vms: DataFrame, c: Constraints, groups: Sequence[str] = (), part_machines: int | None = None) -> DataFrame:
    return place(planned(vms, c, groups, ["performance"]), c, groups, part_machines)


def uniform(vms: DataFrame, c: Constraints, groups: Sequence[str] = (), part_machines: int | None = None) -> DataFrame:
    return place(planned(vms, c, groups, ["uniform"]), c, groups, part_machines)


def _to_propose(sized: DataFrame, iops: DataFrame, groups: Sequence[str], own: Mapping[str, Column], written: bool) -> DataFrame:
    """sized as layouts read it, several times: written once, unless it is, and once more only if its IOPS are guessed."""
    needed = list(dict.fromkeys([*groups, "row_index", "required_mib", "peak_iops", "avg_iops", "workload_key"]))
    rows = (sized.select(*needed) if written else stored(sized.select(*needed), "layout-machines")).withColumns(dict(own))
    if rows.agg(has_measurements().alias("measured")).first()["measured"]:  # with_default_iops() gives rows as they are
        return rows
    return stored(with_default_iops(rows, iops).select(*needed, *own), "layout-iops")


def all_proposals(sized: DataFrame, iops: DataFrame, c: Constraints | None = None, groups: Sequence[str] = (), part_machines: int | None = None, described: bool = False, written: bool = False) -> DataFrame:
    """The placements of the three strategies; sized has workload_key. Machines are read once: strategies and tiers are
    columns, and all of them are packed in one pass. described: with the machines' columns that datastores() needs, as
    sized has them. written: sized is a written table, which isn't written again."""
    c, own = c or Constraints(), {f"own_{x}": F.col(x) for x in _OF_MACHINES} if described else {}
    rows = _to_propose(sized, iops, groups, own, written)
    return place(planned(rows, c, groups, keep=list(own)), c, groups, part_machines, list(own)).withColumnsRenamed({f"own_{x}": x for x in _OF_MACHINES})


def all_stores(sized: DataFrame, iops: DataFrame, c: Constraints | None = None, groups: Sequence[str] = (), part_machines: int | None = None, written: bool = False) -> DataFrame:
    """datastores() of all_proposals(), without a row for each machine and strategy; see place_in_stores()."""
    c, rows = c or Constraints(), _to_propose(sized, iops, groups, {"own_peak_iops": F.col("peak_iops")}, written)
    return place_in_stores(planned(rows, c, groups, keep=["own_peak_iops", "workload_key"]), c, groups, part_machines)


def _dealt(parts: int) -> Column:
    """A machine's part of so many, by a hash that other engines have as well."""
    return F.pmod(F.conv(F.substring(F.md5(F.col("row_index").cast("string").cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(parts)).cast("int")


def place_by_classes(vms: DataFrame, c: Constraints, groups: Sequence[str] = (), salts: int = 1, strategy: str = "classes", prefix: str = "DS_CLASS", described: bool = False) -> DataFrame:
    """Packing for groups of any size, in window functions: a machine's demand is the largest of its shares of space,
    IOPS and count, machines that fit k times in a datastore go k by k. No datastore exceeds a limit, but for a machine
    that does so alone. salts: parts into which a class is split, so that a hot one is spread over tasks. described: with the machines'
    columns that datastores() needs.
    """
    rows, name = _in_classes(vms, c, groups, salts, prefix)
    return rows.select(*groups, F.lit(strategy).alias("strategy"), "row_index", name, *_own_space(c), *(_OF_MACHINES if described else ()))


def _in_classes(vms: DataFrame, c: Constraints, groups: Sequence[str], salts: int, prefix: str) -> tuple[DataFrame, Column]:
    """vms with the class, part and bin that place_by_classes() gives them, and the datastore's name. Classes and parts are
    few and unequal, so they are dealt to all tasks: joined by their bytes, some tasks would hold many of them."""
    demand = F.greatest(F.col("required_mib") / c.usable_mib, F.col("peak_iops") / c.iops_budget, F.lit(1.0 / c.max_machines))
    k = F.greatest(F.floor(1 / demand + 1e-9), F.lit(1)).cast("int")
    rows = vms.withColumn("__k", F.when(demand > 1, 1).otherwise(k)).withColumn("__salt", _dealt(salts))
    rows = rows.repartition(int(vms.sparkSession.conf.get("spark.sql.shuffle.partitions")), *groups, "__k", "__salt")
    n = F.row_number().over(W.partitionBy(*groups, "__k", "__salt").orderBy(F.desc("required_mib"), "row_index")) - 1
    name = F.concat(F.lit(f"{prefix}_"), F.col("__k").cast("string"), F.lit("_"), F.col("__salt").cast("string"), F.lit("_"), F.col("__bin").cast("string"))
    return rows.withColumn("__bin", F.floor(n / F.col("__k"))), name.alias("datastore")


def _own_space(c: Constraints) -> tuple[Column, Column]:
    big = oversized(c)
    return F.when(big, _own_raw(c)).otherwise(F.lit(c.max_mib)).alias("raw_mib"), F.when(big, F.col("required_mib")).otherwise(F.lit(c.usable_mib)).alias("usable_mib")


def stores_by_classes(vms: DataFrame, c: Constraints, groups: Sequence[str] = (), salts: int = 1, strategy: str = "classes", prefix: str = "DS_CLASS") -> DataFrame:
    """datastores() of place_by_classes(): a class's part is in one task, which sums its bins by their numbers, so that
    datastores take no further shuffle and no machine takes a name."""
    rows, name = _in_classes(vms, c, groups, salts, prefix)
    keys = [*groups, "__k", "__salt", "__bin"]
    stores = rows.select(*keys, *_own_space(c), *[F.col(x) for x in _OF_MACHINES]).groupBy(*keys).agg(*_sums())
    return _with_use(stores.select(*groups, F.lit(strategy).alias("strategy"), name, *[x for x in stores.columns if x not in keys]))


def deal_evenly(vms: DataFrame, c: Constraints, slack: float = 1.1, part_machines: int = 100_000, strategy: str = "dealt", prefix: str = "DS_DEALT") -> DataFrame:
    """Balancing for any number of machines: dealt at random into parts of about part_machines; in a part they are ranked
    by space and dealt to its datastores there and back again. No task ranks more than a part.
    Adds over_capacity, which marks all machines of datastores that got too much; place those with place_by_classes()."""
    normal = vms.where(~oversized(c))
    parts = max(1, -(-normal.count() // part_machines))
    rows = normal.withColumn("__part", _dealt(parts))
    sums = rows.groupBy("__part").agg(F.sum("required_mib").alias("mib"), F.sum("peak_iops").alias("iops"), F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.ceil(F.col("mib") / c.usable_mib), F.ceil(F.col("iops") / c.iops_budget), F.lit(1)) * slack
    bins = small(sums.select("__part", F.least(F.ceil(need), "n").cast("long").alias("__bins")))
    rank = F.row_number().over(W.partitionBy("__part").orderBy(F.desc("required_mib"), "row_index")) - 1
    rows = rows.withColumn("__r", rank).join(bins, "__part")
    place, block = F.col("__r") % F.col("__bins"), F.floor(F.col("__r") / F.col("__bins"))
    rows = rows.withColumn("__bin", F.when(block % 2 == 0, place).otherwise(F.col("__bins") - 1 - place))
    full = rows.groupBy("__part", "__bin").agg((F.sum("required_mib") > c.usable_mib).alias("over_capacity"))
    name = F.concat(F.lit(f"{prefix}_"), F.col("__part").cast("string"), F.lit("_"), (F.col("__bin") + 1).cast("string"))
    return rows.join(full, ["__part", "__bin"]).select(F.lit(strategy).alias("strategy"), "row_index", name.alias("datastore"), F.lit(c.max_mib).alias("raw_mib"), F.lit(c.usable_mib).alias("usable_mib"), "over_capacity")


def deal_fully(vms: DataFrame, c: Constraints, slack: float = 1.1, part_machines: int = 100_000, salts: int = 8, strategy: str = "dealt", prefix: str = "DS_DEALT") -> DataFrame:
    """deal_evenly() with no datastore above its space: where one got too much, its largest machines stay as far as they
    fit, by a running sum, and the others go to place_by_classes() together, as <prefix>_MORE_..., marked handed_over."""
    rows = stored(deal_evenly(vms, c, slack, part_machines, strategy, prefix).join(vms.select("row_index", "required_mib", "peak_iops"), "row_index"), "dealt")
    full = rows.where("over_capacity")
    upto = F.sum("required_mib").over(W.partitionBy("datastore").orderBy(F.desc("required_mib"), "row_index"))  # a datastore's machines
    cut = stored(full.withColumn("handed_over", upto > c.usable_mib), "cut")
    more = place_by_classes(cut.where("handed_over"), c, salts=salts, strategy=strategy, prefix=f"{prefix}_MORE").withColumn("handed_over", F.lit(True))
    stay = rows.where("NOT over_capacity").withColumn("handed_over", F.lit(False)).unionByName(cut.where("NOT handed_over"))
    return stay.select(more.columns).unionByName(more)


def datastores(placement: DataFrame, vms: DataFrame | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """A row for each datastore: space, use, utilisation in percent, IOPS, machines and their workloads. A placement that
    was made with `described` needs no join with vms."""
    rows = placement if set(_OF_MACHINES) <= set(placement.columns) else placement.join(vms.select("row_index", *_OF_MACHINES), "row_index")
    return _with_use(rows.groupBy(*groups, "strategy", "datastore").agg(*_sums()))


def _sums() -> list[Column]:
    """What the machines of a datastore give it."""
    return [
        F.max("raw_mib").alias("raw_mib"), F.max("usable_mib").alias("usable_mib"), F.sum("required_mib").alias("used_mib"), F.sum("peak_iops").alias("total_iops"),
        F.count(F.lit(1)).alias("vm_count"), F.sort_array(F.collect_set("workload_key")).alias("workloads"),
    ]


def _with_use(stores: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide("used_mib", "usable_mib") * 100, F.lit(0.0))
    return stores.withColumn("utilization_pct", share).withColumn("band", F.when(share > HIGH_BAND, "high").when(share > MIDDLE_BAND, "middle").otherwise("low"))


def layout_metrics(stores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The figures of each strategy over its datastores."""
    one = stores.groupBy(*groups, "strategy").agg(
        F.count(F.lit(1)).alias("total_ds_count"), F.sum("raw_mib").alias("total_raw_capacity_mib"), F.sum("usable_mib").alias("total_usable_capacity_mib"), F.sum("used_mib").alias("total_used_capacity_mib"),
        F.avg("utilization_pct").alias("avg_utilization_pct"), F.min("utilization_pct").alias("min_utilization_pct"), F.max("utilization_pct").alias("max_utilization_pct"),
        F.avg("vm_count").alias("avg_vm_density"), F.max("vm_count").alias("max_vm_density"), F.sum("total_iops").alias("total_iops_placed"), F.max("total_iops").alias("max_iops_single_ds"),
        (F.count_if(F.size("workloads") <= 1) / F.count(F.lit(1))).alias("isolation_score"), F.coalesce(F.sum(F.when(F.col("datastore").contains("_OVER_"), F.col("vm_count"))), F.lit(0)).alias("oversized_vm_count"),
    )
    headroom = F.when(F.col("max_iops_single_ds") < HEADROOM_IOPS, (1 - F.col("max_iops_single_ds") / HEADROOM_IOPS) * 100).otherwise(0.0)
    rating = F.when(F.col("avg_vm_density") <= 3, "fine").when(F.col("avg_vm_density") <= 10, "medium").otherwise("coarse")
    return one.withColumns({"iops_headroom_pct": headroom, "snapshot_granularity_rating": rating})


def recommend(metrics: DataFrame, vms: DataFrame) -> DataFrame:
    """One row: consolidation for a single workload, else performance if more than half of its datastores hold one
    workload each, else uniform."""
    kinds = vms.agg(F.count_distinct("workload_key").alias("workloads"))
    score = metrics.where(F.col("strategy") == "performance").agg(F.coalesce(F.max("isolation_score"), F.lit(0.0)).alias("isolation_score"))
    return kinds.crossJoin(score).select(F.when(F.col("workloads") <= 1, "consolidation").when(F.col("isolation_score") > 0.5, "performance").otherwise("uniform").alias("strategy"), "workloads", "isolation_score")


METRICS = ("total_ds_count", "total_raw_capacity_mib", "total_usable_capacity_mib", "total_used_capacity_mib", "avg_utilization_pct", "min_utilization_pct", "max_utilization_pct", "avg_vm_density", "max_vm_density", "total_iops_placed", "max_iops_single_ds", "iops_headroom_pct", "isolation_score", "oversized_vm_count")


def comparison(metrics: DataFrame) -> DataFrame:
    """A row for each figure, a column for each strategy."""
    rows = metrics.select("strategy", *[F.col(m).cast("double").alias(m) for m in METRICS])
    return rows.unpivot("strategy", list(METRICS), "metric", "value").groupBy("metric").pivot("strategy", ["consolidation", "performance", "uniform"]).agg(F.first("value"))


def drill_down(placement: DataFrame, vms: DataFrame) -> DataFrame:
    """Machines by strategy and datastore, largest first."""
    rows = placement.select("strategy", "datastore", "row_index").join(vms.select("row_index", "vm_name", "workload_key", "required_mib", "peak_iops"), "row_index")
    return rows.orderBy("strategy", "datastore", F.desc("required_mib"), "row_index")
