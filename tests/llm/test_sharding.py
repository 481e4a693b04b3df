import random
import zlib

import pytest

from stratasize.llm import queries, sharding
from stratasize.llm.sharding import shard_documents, write_shards

SCHEMA = "doc_id long, text string, source string, size string, __place long, shard string"


def plain(rows, shards):
    """(id, text) in order with shard and slot, one document after the other."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 16 for _, t in order]
    whole, before, out, slots = sum(sizes), 0, [], {}
    for (i, t), size in zip(order, sizes):
        s = min((2 * before + size) * shards // (2 * whole), shards - 1)
        slots[s] = slots.get(s, -1) + 1
        out.append((i, t, size, s, slots[s]))
        before += size
    return out


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_shards_equal_a_plain_pass(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(60), "w" * rng.randrange(400)])) for i in range(300)]
    rows[120] = (120, "long " * 5000)  # fills shards alone
    docs = spark.createDataFrame([(*r, "s", "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    found = shard_documents(docs, shards)
    assert sorted(found.columns) == sorted(docs.columns + ["slot"])
    got = sorted((r["doc_id"], r["text"], r["size"], r["shard"], r["slot"]) for r in found.select("doc_id", "text", "size", "shard", "slot").collect())
    assert got == sorted(plain(rows, shards))


def test_rows_that_repeat_and_null_ids(spark):
    rows = [(None, "same")] * 200 + [(None, f"t{i}") for i in range(50)] + [(7, "same")] * 100 + [(8, None)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    assert sorted(map(str, rows)) == sorted(str((r["doc_id"], r["text"])) for r in found)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 20
    assert max(s for s, x in by.items() if any(r["doc_id"] is None for r in x)) <= min(s for s, x in by.items() if any(r["doc_id"] == 7 for r in x))


def test_empty_and_files(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert shard_documents(docs.limit(0)).count() == 0
    write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["doc_id"], r["text"], r["size"], r["shard"], r["slot"]) for r in back) == sorted(plain([(r["doc_id"], r["text"]) for r in docs.collect()], 5))
    with pytest.raises(ValueError):
        shard_documents(docs, 0)


def test_many_partitions(spark, small):
    """More range partitions than rows in some, so that cuts fall between partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        found = queries.op11_sharding(spark, small).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: (size, zlib.crc32((t or "").encode()), s, slot) for i, t, size, s, slot in plain(rows, 40)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in found} == want
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)} and sharding.OVERHEAD == 16
