"""Shards against their law, on tables with odd rows, hot groups and long texts."""

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
from taxaflow.llm import queries, sharding


def held(rows, out, shards):
    """Every row once, sizes and checksums as they are, slots without gaps; bytes and texts by shard."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, bytes_, where = defaultdict(list), [0] * shards, defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    assert set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return bytes_, where


def table(spark, rows):
    """With columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id bigint, text string, k1 string, range int, size int")


def test_even_bytes_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"own {i} " + "x" * int(rng.pareto(1.5) * 40)) for i in range(3000)] + [(5000 + i, "the same text in a third of all rows") for i in range(1500)]
    rows += [(9, "a"), (9, "a"), (None, None), (None, ""), (7, None), (8, "é 数据 " * 2000)]
    bytes_, where = held(rows, sharding.assign(table(spark, rows), 7).collect(), 7)
    mean = sum(bytes_) / 7
    assert max(bytes_) < 1.02 * mean and min(bytes_) > 0.98 * mean
    hot = zlib.crc32(b"the same text in a third of all rows")
    assert len(where[hot]) == 7  # divided, as one shard can't hold it
    assert all(len(v) == 1 for k, v in where.items() if k != hot)  # no other group is


def test_one_key_and_rows_bound(spark):
    rows = [(1, "always")] * 900
    out = sharding.assign(table(spark, rows), 3, most_rows=50).collect()
    bytes_, _ = held(rows, out, 3)
    assert max(bytes_) - min(bytes_) < 0.1 * sum(bytes_)
    assert max(Counter(r.range for r in out).values()) <= 2 * 50 + 1


def test_near_the_best_deal(spark):
    """Few rows of very different sizes: no worse than dealing the texts by size, plus one range."""
    rows = [(i, "y" * (10_000 // (i + 1))) for i in range(60)]
    bytes_, _ = held(rows, sharding.assign(table(spark, rows), 4).collect(), 4)
    heap = [0] * 4
    for size in sorted((len(t) + 16 for _, t in rows), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + size)
    assert max(bytes_) <= max(heap) + 2 * sum(bytes_) / (4 * sharding.RANGES)


def test_empty_and_single(spark):
    assert sharding.assign(table(spark, []), 40).count() == 0
    one = sharding.assign(table(spark, [(3, "z")]), 40).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_query_and_files(spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 9)) for i in range(400)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_sharding(spark, str(tmp_path))
    assert out.columns == "doc_id size text_crc32 law shard slot grown_shard".split()
    held(rows, out.collect(), 40)
    sharding.write_shards(table(spark, rows), f"{tmp_path}/shards", 5)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r.row.doc_id, r.row.text, r.row.k1) for r in back.collect()) == Counter((i, t, "k") for i, t in rows)
    assert "Python" not in (plan := out._jdf.queryExecution().toString()) and "Arrow" not in plan
