"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard.

Equal vectors are indexed once (all their ids stay attached, through the k + 1 smallest, which are all that a list of
the k nearest can hold under ties to smaller ids). Distinct vectors are dealt to shards of about SHARD rows by hash;
each shard's graph is built from its top level down, a node entering a level where the levels above lead it, as flat
neighbour arrays in a task, to which the queries then come, a batch at a time: neither a graph nor a block of queries is a row.
All that a walk's beam holds is scored in double precision on the original vectors, and then shard results are merged.

A query meets each shard once, so the work is (queries) * (vectors / SHARD) walks; larger shards mean fewer of them, and
a shard of SHARD vectors takes about 1 KB for each.

Vectors that are null, zero, or hold null or non-finite components take no part, as rows with a null id. Vectors of other
lengths are compared with their like only. With fewer than k candidates all are returned. Ties go to the smaller id. Rows that repeat an id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, bound_batches

#: Vectors in a shard, neighbours of a node, width of the beam at building and at searching.
SHARD, LINKS, BUILD_WIDTH, SEARCH_WIDTH = 1 << 14, 12, 48, 256
#: Bytes of the table of visited nodes (walks * vectors) of one step.
VISITED = 1 << 25


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beam(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, that a beam of this width finds for each query. -1: none.

    links: node x places, -1 where a place is empty. All queries take their step at the same time: each opens its best
    node that is not yet open, until none in its beam is left.
    """
    n = len(queries)
    seen = np.zeros((n, len(vectors)), bool)
    rows = np.arange(n)
    nodes = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    nodes[:, 0], done[:, 0] = entries, False
    sims[:, 0] = np.einsum("ij,ij->i", queries, vectors[entries])
    seen[rows, entries] = True
    active = rows
    while len(active):
        waiting = np.where(done[active], -np.inf, sims[active])
        best = waiting.argmax(1)
        going = waiting[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        near = links[nodes[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        a, place = np.nonzero(fresh)
        new = near[a, place]
        seen[active[a], new] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[a, place] = np.einsum("ij,ij->i", queries[active[a]], vectors[new])
        all_sims = np.concatenate([sims[active], got], 1)
        top = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        take = lambda old, add: np.take_along_axis(np.concatenate([old, add], 1), top, 1)
        nodes[active] = take(nodes[active], np.where(fresh, near, -1))
        done[active] = take(done[active], ~fresh)
        sims[active] = np.take_along_axis(all_sims, top, 1)
    return np.where(np.isfinite(sims), nodes, -1), sims


def diverse(own: np.ndarray, near: np.ndarray, vectors: np.ndarray, places: int) -> np.ndarray:
    """Of the candidates (best first) those closer to the node than to a chosen one, then the rest, up to `places`."""
    chosen: list[int] = []
    spare: list[int] = []
    to_own = vectors[near] @ vectors[own]
    between = vectors[near] @ vectors[near].T
    at: list[int] = []
    for i, node in enumerate(near):
        if len(chosen) == places:
            break
        if all(between[i, j] < to_own[i] for j in at):
            chosen.append(int(node))
            at.append(i)
        else:
            spare.append(int(node))
    return np.array((chosen + spare)[:places], np.int64)


def build(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """(level of each node, links of each level) of a graph over unit vectors.

    Levels are built from the top. On each, the members of the level above come first; then nodes are inserted in growing
    batches: a batch enters where the levels above lead it, searches the graph so far (the first few, each other), and links
    both ways; a node with too many links keeps a diverse choice of them.
    """
    n = len(vectors)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
    top = int(levels.max()) if n else -1
    all_links: list[np.ndarray] = [np.zeros((0, 0), np.int64)] * (top + 1)
    for level in range(top, -1, -1):
        places = LINKS * (2 if level == 0 else 1)
        links = np.full((n, places), -1, np.int64)
        members = np.flatnonzero(levels >= level)
        members = members[np.argsort(levels[members] == level, kind="stable")]
        above = int((levels > level).sum())
        at = 0
        while at < len(members):
            batch = members[at : at + min(max(64, at // 2), max(64, VISITED // n))]
            sims = vectors[batch] @ vectors[batch].T
            peers = batch[np.argsort(-sims, 1, kind="stable")[:, : LINKS + 1]]
            if at:
                if above and at >= above:
                    entries = descended(vectors[batch], vectors, levels, all_links, level)
                else:  # the first few, where no level leads
                    entries = members[:at][(vectors[batch] @ vectors[members[: min(at, 32)]].T).argmax(1)]
                found, _ = beam(vectors[batch], vectors, links, entries, BUILD_WIDTH)
                peers = np.concatenate([found, peers], 1)
            touched: dict[int, list[int]] = {}
            for node, near in zip(batch, peers):
                near = np.unique(near[(near >= 0) & (near != node)])
                near = near[np.argsort(-(vectors[near] @ vectors[node]), kind="stable")][:BUILD_WIDTH]
                mine = diverse(node, near, vectors, LINKS)
                links[node, : len(mine)] = mine
                for other in mine:
                    touched.setdefault(int(other), []).append(int(node))
            for node, new in touched.items():
                near = np.unique(np.concatenate([links[node][links[node] >= 0], new]))
                if len(near) > places:
                    near = near[np.argsort(-(vectors[near] @ vectors[node]), kind="stable")]
                    near = diverse(node, near, vectors, places)
                links[node] = -1
                links[node, : len(near)] = near
            at += len(batch)
        all_links[level] = links
    return levels, all_links


def descended(queries: np.ndarray, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], to: int) -> np.ndarray:
    """Where each query enters level `to`: the best node that a narrow walk down from the top level finds."""
    entries = np.full(len(queries), int(levels.argmax()))
    for level in range(len(links) - 1, to, -1):
        entries = beam(queries, vectors, links[level], entries, 4)[0][:, 0]
    return entries


def search(queries: np.ndarray, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], width: int) -> np.ndarray:
    """The nodes (-1: none) that a beam of this width holds for each query after a walk from the top level down."""
    out = np.empty((len(queries), width), np.int64)
    step = max(1, VISITED // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        out[at : at + step] = beam(part, vectors, links[0], descended(part, vectors, levels, links, 0), width)[0]
    return out


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, list[str], np.ndarray, np.ndarray]]:
    """dims, asked, keys, vectors, least of rows beside each other that have vectors of one length and are all asked or all not."""
    for batch in batches:
        dims, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "asked"))
        begins = np.flatnonzero(np.diff(2 * dims.astype(np.int64) + asked, prepend=-1))
        for begin, end in zip(begins, [*begins[1:], len(dims)]):
            part = batch.slice(begin, end - begin)
            vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(end - begin, dims[begin])
            yield int(dims[begin]), bool(asked[begin]), part.column("key").to_pylist(), vectors, part.column("least").to_numpy(zero_copy_only=False)


def searched(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """asked, key, least, score: for each query the best k + 1 that a walk of this shard holds, by the exact measure.

    Rows of a shard: of each length its vectors, then the queries. What is held is the graph and a batch of queries.
    """
    length, held, graph = -1, [], None
    for dims, asked, names, wanted, ids in runs(batches):
        if not asked:
            if dims != length:
                length, held, graph = dims, [], None
            held.append((names, wanted.copy(), ids.astype(np.int64)))
        if not asked or dims != length:  # no vector of that length in this shard
            continue
        if graph is None:
            keys, vectors, least = [x for h in held for x in h[0]], *(np.concatenate([h[i] for h in held]) for i in (1, 2))
            units, norms, held = unit(vectors).astype(np.float32), np.linalg.norm(vectors, axis=1), []
            graph = build(units)
        nodes = search(unit(wanted).astype(np.float32), units, *graph, max(SEARCH_WIDTH, k + 1))
        own_norms = np.linalg.norm(wanted, axis=1)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, found in enumerate(nodes):
            found = found[found >= 0]
            score = vectors[found] @ wanted[i] / (norms[found] * own_norms[i])
            best = np.lexsort((least[found], -score))[: k + 1]
            for column, values in zip(out, ([names[i]] * len(best), [keys[x] for x in found[best]], least[found[best]].tolist(), score[best].tolist())):
                column += values
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["asked", "key", "least", "score"])


def usable(vector: Column) -> Column:
    """The vector as doubles; null if it takes no part."""
    v = vector.cast("array<double>")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    return F.when(~bad, v)


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that is_query holds for, without itself."""
    spark = df.sparkSession
    ws = Workspace(spark, "ann")
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), usable(F.col(vector_column)).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    rows = ws.write(rows.withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)))
    dims = F.size("v").alias("dims")

    order = Window.partitionBy("key").orderBy("id")
    ids = rows.select("key", "id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("key", "id")
    index = rows.groupBy("key").agg(F.first("v").alias("v"), F.min("id").alias("least")).select("key", "v", "least", dims)
    counts = {r[0]: r[1] for r in index.groupBy("dims").count().collect()}  # one row for each vector length
    shards = max(1, -(-max(counts.values(), default=1) // shard))
    index = index.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("asked", F.lit(False))
    asked = rows.where("q").select("key", "v", F.lit(None).cast("bigint").alias("least"), dims).distinct()
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asked", F.lit(True))
    # Rows stay as narrow as vectors: a shard's own come first, and its queries meet its graph in the task that builds it.
    bound_batches(spark)
    dealt = index.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("dims", "asked", "key")
    found = dealt.select("dims", "asked", "key", "v", "least").mapInArrow(lambda batches: searched(batches, k), "asked string, key string, least bigint, score double")
    # Of keys with equal scores those with the smallest ids: each key before the cut has an id that goes first.
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "least")
    found = ws.write(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r", "least"))

    queries = rows.where("q").select(F.col("key").alias("asked"), F.col("id").alias("query_id")).distinct()
    pairs = queries.join(found, "asked").join(ids.withColumnRenamed("id", "vec_id"), "key").where("vec_id != query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(final).cast("int"))
    out = ws.write(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    ws.drop_all_but(out)
    return out
