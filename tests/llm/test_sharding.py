"""Rendezvous shards against the definition, and what must hold when shards change."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilwright.llm import sharding


def bits(key, j):
    return int(hashlib.md5(f"{j}|{key}".encode()).hexdigest()[:13], 16)


def best(key, weights):
    return min(range(len(weights)), key=lambda j: (-math.log((bits(key, j) + 0.5) / 16**13) / weights[j], j))


def test_shards_and_slots_equal_the_definition(spark):
    docs = [(i, f"text {i % 7} é" * (i % 5)) for i in range(500)] + [(3, "again"), (3, "again"), (None, None), (None, "x"), (4, None), (5, "")] + [(77, "hot")] * 400
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in docs], "doc_id long, text string, shard string, slot int").repartition(6)
    weights, grown = [1.0, 2.0, 0.5, 1.0, 3.0], [1.5]
    out = sharding.place(sharding.assign(df.drop("slot"), "doc_id", weights, grown), "doc_id", ["size", "text_crc32"])
    got = out.collect()
    assert len(got) == len(docs)
    key = lambda i: "" if i is None else str(i)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), best(key(i), weights), best(key(i), weights + grown)) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, bits(key(r.doc_id), r.shard)))
    for x in slots.values():
        x.sort()
        assert [s for s, _ in x] == list(range(len(x))) and [b for _, b in x] == sorted(b for _, b in x)


def test_shares_follow_weights_and_few_records_move(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 3.0, 2.0]
    n = {r.s: r["count"] for r in keys.select(sharding.shard_of(F.col("k"), weights).alias("s")).groupBy("s").count().collect()}
    assert all(abs(n[j] / 40_000 - w / 8) < 0.01 for j, w in enumerate(weights))
    more = sharding.moves(keys, "k", weights, [*weights, 2.0]).collect()
    assert {r.to_shard for r in more} == {4} and abs(len(more) / 40_000 - 0.2) < 0.01
    heavier = sharding.moves(keys, "k", weights, [1.0, 4.0, 3.0, 2.0]).collect()
    assert {r.to_shard for r in heavier} == {1}
    gone = sharding.moves(keys, "k", weights, weights[:3]).collect()
    assert {r.from_shard for r in gone} == {3}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"document {i}") for i in range(300)], "doc_id long, text string")
    out = f"file://{tmp_path}/shards"
    told = {r.shard: (r.rows, r.bytes) for r in sharding.write_shards(df, "doc_id", [1.0] * 4, out, rows_per_file=50).collect()}
    back = spark.read.parquet(out)
    assert sum(n for n, _ in told.values()) == 300 and {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in df.collect()}
    slots = defaultdict(list)
    for r in back.collect():
        assert r.shard == best(str(r.doc_id), [1.0] * 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(told[s][0])) for s, x in slots.items())


def test_empty_table_and_bad_weights(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.place(sharding.assign(df, "doc_id", [1.0, 1.0]), "doc_id").collect() == []
    for weights in ([], [1.0, 0.0]):
        try:
            sharding.shard_of(F.col("doc_id"), weights)
            raise AssertionError("accepted")
        except ValueError:
            pass
