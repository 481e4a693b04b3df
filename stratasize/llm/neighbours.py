"""Approximate nearest neighbours: random-projection trees under one priority queue, then exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratasize.llm.common import bounded_batches, written


#: Levels whose nodes have normals of their own, and levels at most; rows of the sample for each leaf.
UPPER, DEEPEST, PER_LEAF = 9, 15, 4


@dataclass
class Forest:
    """Complete trees. Node i of a tree has the children 2 i + 1 and 2 i + 2; its right child is above the threshold.

    Nodes of the upper levels have a normal each, those of a level below share one, so that normals stay small however
    deep a tree is; thresholds are each node's own.
    """

    normals: np.ndarray  # (trees, normals, dimensions)
    normal_of: np.ndarray  # (nodes,)
    thresholds: np.ndarray  # (trees, nodes)
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each row in each tree."""
        out = np.zeros((len(self.normals), len(x)), dtype=np.int32)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                above = np.einsum("ij,ij->i", x, self.normals[t][self.normal_of[node]]) > self.thresholds[t][node]
                node = 2 * node + 1 + above
            out[t] = node - (2**self.depth - 1)
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, wanted: int) -> list[list[tuple[int, int]]]:
        """For each row, the (tree, leaf) pairs in which it looks: all trees' nodes wait in one queue by the least margin
        on their paths, until the leaves taken hold so many rows (sizes: (trees, leaves))."""
        nodes, which, thresholds = 2**self.depth - 1, self.normal_of.tolist(), self.thresholds.tolist()
        flat = self.normals.reshape(-1, self.normals.shape[-1])
        out = []
        for at in range(0, len(x), 256):
            for own in (x[at : at + 256] @ flat.T).reshape(-1, *self.normals.shape[:2]).tolist():
                queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
                heapq.heapify(queue)
                found, held = [], 0
                while queue and held < wanted:
                    cost, tree, node = heapq.heappop(queue)
                    if node >= nodes:
                        if sizes[tree][node - nodes]:
                            found.append((tree, node - nodes))
                            held += sizes[tree][node - nodes]
                        continue
                    margin = own[tree][which[node]] - thresholds[tree][node]
                    heapq.heappush(queue, (max(cost, -margin), tree, 2 * node + 2))
                    heapq.heappush(queue, (max(cost, margin), tree, 2 * node + 1))
                out.append(found)
        return out


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 1) -> Forest:
    """Random unit normals; each threshold is the median of the sample's projections at its node."""
    rng = np.random.default_rng(seed)
    nodes, upper = 2**depth - 1, 2 ** min(depth, UPPER) - 1
    level = np.floor(np.log2(np.arange(nodes) + 1)).astype(np.int64)
    normal_of = np.where(level < UPPER, np.arange(nodes), upper + level - UPPER)
    normals = rng.standard_normal((trees, upper + max(0, depth - UPPER), sample.shape[1]))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    thresholds = np.zeros((trees, nodes))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = rows.pop(node)
            p = sample[own] @ normals[t, normal_of[node]]
            thresholds[t, node] = np.median(p) if len(p) else 0.0
            rows[2 * node + 1], rows[2 * node + 2] = own[p <= thresholds[t, node]], own[p > thresholds[t, node]]
    return Forest(normals, normal_of, thresholds, depth)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """rows: (vec_id, v). A row for each distinct v: class_id, any number of its own (fixed once it is written), and
    ids, its `keep` smallest ones.

    Equal vectors combine inside each batch before they are shuffled, so a hot vector sends few ids from each.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not x.size:
                continue
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            _, first, group = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
            by_group = np.argsort(group, kind="stable")
            parts = np.split(ids[order][by_group], np.cumsum(np.bincount(group))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([p[:keep] for p in parts], pa.list_(pa.int64())), batch.column(1).take(pa.array(order[first]))], ["ids", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    found = rows.select("vec_id", "v").mapInArrow(combine, f"ids array<long>, v {kind}")
    merged = found.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    return merged.select(F.monotonically_increasing_id().alias("class_id"), "ids", "v")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, no null or non-finite component, not zero; of those only the
    most frequent length (the shorter on a tie)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    trees: int = 8,
    leaf_rows: int = 200,
    search_share: float = 1.35,
    sample_rows: int = 20_000,
    shard_rows: int = 65_536,
    block_queries: int = 16_384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For each vector whose id is divisible by `every`, the k others with the largest inner product: query_id, rank,
    vec_id, score (in double precision, of the original vectors), nearest first, ties to the smaller vec_id.

    The trees' splits are fitted on a bounded sample (sample_rows, or 4 a leaf, at most 131,072); every vector is in a leaf of every tree. A query takes leaves from
    the shared queue until they hold search_share times all vectors, counted over trees (at 8 trees 1.35 reads about
    three quarters of the distinct vectors: directions without any structure need it; less will do where there is some).
    Leaves go by shards, each with a bounded number of rows, against queries in blocks, and all in them are scored.

    Equal vectors are one row of the index with their k + 1 smallest ids, which are all that a result can hold; equal
    queries search once. Vectors that are null, zero, or hold null or non-finite components, null ids and rare lengths
    take no part (usable()). Rows that repeat an id and vector count as one row; those that repeat an id with other
    vectors are queries and candidates of their own. Fewer than k others: all of
    them. Empty table: empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).distinct()
    rows = written(bounded_batches(rows), "vectors")
    classes = written(distinct_vectors(rows, k + 1), "vector-classes")
    n = classes.count()
    sought = written(rows.where(F.col("vec_id") % every == 0).join(classes.select("v", "class_id"), "v").select("vec_id", "class_id"), "vector-queries")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    depth = int(np.clip(round(np.log2(max(n / leaf_rows, 1))), 1, DEEPEST))
    sample_rows = max(sample_rows, PER_LEAF << depth)
    space = 1 << 30
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(space)) < min(space, space * 5 // 4 * sample_rows // n + 1)).select("v").limit(sample_rows).toArrow()
    forest = fit_forest(_matrix(sample["v"].combine_chunks() if sample.num_rows else pa.array([[0.0] * classes.select(F.size("v")).first()[0]])), trees, depth)
    per_tree = max(1, -(-n // shard_rows))
    leaves = 2**depth

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.leaves(_matrix(batch.column(2)))
            for t in range(trees):
                shard = pa.array(t * per_tree + found[t].astype(np.int64) * per_tree // leaves, pa.int32())
                yield pa.RecordBatch.from_arrays([shard, pa.array(found[t]), *batch.columns], ["shard", "leaf", "class_id", "ids", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    planted = written(classes.mapInArrow(plant, f"shard int, leaf int, class_id long, ids array<long>, v {kind}"), "vector-leaves")
    sizes = np.zeros((trees, leaves), dtype=np.int64)  # as many rows as the forest has leaves
    for r in planted.groupBy(F.floor(F.col("shard") / per_tree).alias("tree"), "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]
    counts, wanted = sizes.tolist(), int(search_share * n) + k + 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = []
                for i, found in enumerate(forest.search(_matrix(part.column(1)), counts, wanted)):
                    by_shard: dict[int, list[int]] = {}
                    for tree, leaf in found:
                        by_shard.setdefault(tree * per_tree + leaf * per_tree // leaves, []).append(leaf)
                    out += [(s, i, own) for s, own in by_shard.items()]
                of = pa.array([r[1] for r in out], pa.int64())
                block = pa.array(forest.leaves(_matrix(part.column(1)))[0].astype(np.int64) * blocks // leaves, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.int32())), block.take(of), *part.take(of).columns], ["shard", "leaves", "block", "q", "v"])

    queries = sought.select("class_id").distinct()
    # A block's queries are neighbours in the first tree, so they ask for the same leaves.
    blocks = max(1, -(-queries.count() // block_queries))
    queries = queries.join(classes, "class_id").select(F.col("class_id").alias("q"), "v")
    looking = written(queries.repartition(F.col("q")).mapInArrow(look, f"shard int, leaves array<int>, block int, q long, v {kind}"), "vector-searches")
    asked = looking.select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), F.explode("leaves").alias("of_leaf")).distinct()
    spread = planted.join(asked, (F.col("shard") == F.col("of_shard")) & (F.col("leaf") == F.col("of_leaf"))).select(*planted.columns, F.col("of_block").alias("block"))

    def score(held: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["q", "class_id", "score", "ids"], [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        if not held.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        held = held.take(pa.array(np.argsort(held["leaf"].to_numpy(), kind="stable")))
        x, leaf, own_id, ids = _matrix(held["v"].combine_chunks()), held["leaf"].to_numpy(), held["class_id"].to_numpy(), held["ids"].combine_chunks()
        least_id = ids.flatten().to_numpy()[np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())[:-1]))]
        q, lists = _matrix(asked["v"].combine_chunks()), asked["leaves"].combine_chunks()
        visit_q = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        visit = lists.flatten().to_numpy()
        order = np.argsort(visit, kind="stable")
        visit, visit_q = visit[order], visit_q[order]
        got = []
        for one in np.unique(visit):
            a, b = np.searchsorted(leaf, [one, one + 1])
            c, d = np.searchsorted(visit, [one, one + 1])
            for e in range(c, d, 512):  # a bounded block of scores
                of = visit_q[e : min(e + 512, d)]
                s = q[of] @ x[a:b].T
                if b - a > k + 1:
                    least = np.partition(s, b - a - k - 1, axis=1)[:, b - a - k - 1]
                    i, j = np.nonzero(s >= least[:, None])
                else:
                    i, j = np.divmod(np.arange(s.size), b - a)
                got.append((of[i], j + a, s[i, j]))
        of, at, s = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((least_id[at], -s, of))
        of, at, s = of[order], at[order], s[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        top = rank <= k
        return pa.Table.from_arrays([pa.array(asked["q"].to_numpy()[of[top]]), pa.array(own_id[at[top]]), pa.array(s[top]), ids.take(pa.array(at[top]))], names)

    scored = spread.groupBy("shard", "block").cogroup(looking.groupBy("shard", "block")).applyInArrow(score, "q long, class_id long, score double, ids array<long>")
    found = scored.groupBy("q", "class_id").agg(F.max("score").alias("score"), F.first("ids").alias("ids")).select("q", F.col("class_id").alias("of"), "score", F.explode("ids").alias("id"))
    best = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id", "of"))).where(F.col("n") <= k + 1)
    # A query is a row, told apart by its id and vector, and so is the candidate that is the query itself.
    out = sought.join(best, sought["class_id"] == best["q"]).where("id <> vec_id OR of <> q")
    rank = F.row_number().over(W.partitionBy("vec_id", "q").orderBy(F.desc("score"), "id", "of"))
    return out.select(F.col("vec_id").alias("query_id"), rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)
