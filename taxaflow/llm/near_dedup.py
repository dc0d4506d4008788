"""Near-duplicate documents by SetSketch registers.

Each set of word shingles gets M registers: register i holds floor(1 - log_B(x)) of the least of exponentially
spaced hash values x over the set, truncated to [0, Q + 1]. Registers of a union are the maxima of the registers.
Bands of registers retrieve candidates, the likelihood of a pair's registers (given both set sizes) prunes them,
and every link is confirmed on the full sets.

Only links between different components matter, so a bucket never yields all its pairs at once. Each member first
meets two leaders of its bucket (a number of rows linear in the bucket's size). Then, for the buckets that still
hold several components, the pairs across components are compared inside blocks of the bucket: first by registers, which
leaves the members with a plausible partner; blocks of those alone carry full sets of shingle hashes, and compare them.
Only links that join two components leave a block, fewer than it has members; they are confirmed on the texts. What ends
up unlinked has had every candidate pair across components compared. A link of similarity 0.8 or more is missed at a
probability of about 5e-7 by the registers and 3e-8 by the bands.

Results for odd input: a null or blank text has no shingles, is linked with nothing and is kept; a row with a null id
takes no part and is kept with a null component; rows that repeat an id are classed by their own text; ties go to
the smallest id; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, _arrow, map_texts

#: Registers, their base, rate and largest value; registers in a band. At a similarity of 0.8 two sets
#: share no band with probability 3e-8.
M, BASE, RATE, Q, ROWS = 128, 1.05, 20.0, 1022, 4
#: A pair is dropped without a look at its sets only if similarity 0.8 is exp(SLACK) times less likely than the best.
SLACK = 12.0
#: Registers of documents whose bucket still holds several components, and the slack there: nothing tries a pair again that
#: is dropped then, so it is five standard errors too.
FINE, FINE_SLACK = 640, 12.0
#: Ids that may be broadcast to thin out the texts before a join (8 bytes each); beyond it a plain join does.
BROADCAST_IDS = 1_000_000
#: Members of a bucket in one block, and bytes of their shingle hashes, about.
BLOCK, BLOCK_BYTES = 4096, 1 << 24
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, FINE, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**63, M // ROWS, dtype=np.uint64) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Hashes of words, kept for the next texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text with A-Z in lower case."""
    return text.lower().split()


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; the whole sequence is one if it has fewer words."""
    words = words_of(text)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1) if len(h) else 0
    size = min(size, len(h))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * _MUL + h[k : k + n])
    return np.unique(out)


def registers(hashes: np.ndarray, m: int = M) -> np.ndarray:
    """The first m registers of a set of hashes."""
    best = np.full(m, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        x = hashes[at : at + 256, None] * _A[:m]
        x += _B[:m]
        np.minimum(best, x.min(0), out=best)
    x = -np.log1p(-(unit(best))) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as doubles inside (0, 1)."""
    return (x.astype(np.float64) + 1) / (2.0**64 + 4096)


def band_keys(regs: np.ndarray) -> np.ndarray:
    return mixed(regs[:M].view(np.uint64) * _BAND + _BAND).view(np.int64)


def likely(d_more: np.ndarray, d_less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, least: float, m: int = M, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """The joint maximum-likelihood similarity from register comparisons and set sizes, and whether `least` is plausible."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    d_same = m - d_more - d_less

    def p(x):
        return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        return d_more * np.log(more) + d_less * np.log(less) + d_same * np.log(np.maximum(1 - more - less, 1e-12))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    most = high.copy()
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(a) < log_likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    best = (low + high) / 2
    at = np.minimum(least, most)
    return best, (most >= least - 1e-9) & ((best >= least) | (log_likelihood(best) - log_likelihood(at) <= slack))


def sketches(df: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """id_column, n_shingles, digest (of the whole set; null if empty), regs, keys (one for each band)."""

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        for text in texts:
            h = shingle_hashes(text, size)
            if len(h):
                regs = registers(h)
                yield len(h), xxhash.xxh3_128_digest(h.tobytes()), regs.tobytes(), band_keys(regs).tolist()
            else:
                yield 0, None, None, None

    return map_texts(df, [id_column], text_column, "n_shingles bigint, digest binary, regs binary, keys array<bigint>", run)


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may reach `least`, with the estimate."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            ra, rb = (np.frombuffer(b"".join(at[k].to_pylist()), np.uint16).reshape(-1, M) for k in ("r_a", "r_b"))
            na, nb = (at[k].to_numpy().astype(float) for k in ("n_a", "n_b"))
            best, keep = likely((ra > rb).sum(1).astype(float), (ra < rb).sum(1).astype(float), na, nb, least)
            yield pa.RecordBatch.from_arrays([at["a"].filter(pa.array(keep)), at["b"].filter(pa.array(keep)), pa.array(best[keep])], names=["a", "b", "est"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint, est double")


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts with these ids."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def shingles(text: bytes | None) -> set:
        words = words_of(text or b"")
        return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} - {()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                sa, sb = shingles(ta.as_py()), shingles(tb.as_py())
                both = len(sa & sb)
                keep.append(bool(sa) and 100 * both >= percent * (len(sa) + len(sb) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    ids = pairs.select(F.col("b").alias("id")).union(pairs.select(F.col("a").alias("id"))).distinct()
    texts = only(texts, ids)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")
    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the edges (a, b) can reach, by alternating star steps."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        edges = ws.write(near.select("u", F.col("m").alias("v")).union(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        several = edges.groupBy("u").count().where("count > 1").select("u")
        if chained.union(several).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, leads): the members of the buckets that hold several, with two leaders, chosen by id and by hash.

    The choice is the same in each bucket, so the many buckets of one group of copies yield the same pairs.
    """
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    me = F.struct("node", "n")
    leads = rows.groupBy("key").agg(F.min(me).alias("first"), F.min_by(me, F.xxhash64("node")).alias("low"), F.count("*").alias("k")).where("k > 1")
    return rows.join(leads.select("key", F.array("first", "low").alias("leads")), "key").select("key", "node", "n", "leads")


def leader_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each member of a bucket with the leaders of it."""
    met = buckets.select("node", "n", F.explode("leads").alias("lead"))
    fits = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    return met.where((F.col("node") != F.col("lead.node")) & fits).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def across_links(ws: Workspace, buckets: DataFrame, comps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b), a < b: links between members of a bucket that lie in different components; enough of them to join what is linked.

    The documents of such buckets get FINE registers. In a bucket the members outside its largest component meet all its
    members. Both sides come in blocks, so a large bucket is dealt to many tasks. A pair is compared in the first bucket that
    the two share, unless links of this block have joined their components before.
    """
    least = percent / 100
    rows = buckets.select("key", "node", "n").join(comps, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), "key")
    tally = rows.groupBy("key", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("sum")).groupBy("key")
    tally = tally.agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("k"), F.max("count").alias("most"), F.sum("sum").alias("all"), F.max_by("sum", F.struct("count", "comp")).alias("main_sum"))
    blocks = lambda k, n: F.ceil(F.greatest(k / BLOCK, 8 * n / BLOCK_BYTES)).cast("bigint")
    tally = tally.where("k > most").select("key", "main", blocks(F.col("k"), F.col("all")).alias("n_big"), blocks(F.col("k") - F.col("most"), F.col("all") - F.col("main_sum")).alias("n_small"))
    rows = ws.write(rows.join(tally, "key").withColumn("out", F.col("comp") != F.col("main")))

    def fine(ts: Iterable[bytes]) -> Iterator[tuple]:
        for t in ts:
            yield (registers(shingle_hashes(t, size), FINE).tobytes(),)

    def whole(ts: Iterable[bytes]) -> Iterator[tuple]:
        for t in ts:
            yield (shingle_hashes(t, size).tobytes(),)

    def made_of(rows: DataFrame, written: DataFrame, name: str, make: Callable) -> DataFrame:
        """rows with what `make` gives for the text of their node; written: a table of those nodes."""
        made = map_texts(only(texts, written.select(F.col("node").alias("id")).distinct()), ["id"], "text", f"{name} binary", make)
        return rows.join(made.groupBy(F.col("id").alias("node")).agg(F.first(name).alias(name)), "node")

    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    # A member that asks and is asked in the same block goes there once.
    big = rows.select("*", spread("n_big").alias("i"), upto("n_small").alias("j")).withColumn("asks", F.col("out") & (F.col("j") == spread("n_small"))).withColumn("asked", F.lit(True))
    small = rows.where("out").select("*", upto("n_big").alias("i"), spread("n_small").alias("j")).where(F.col("i") != spread("n_big")).withColumn("asks", F.lit(True)).withColumn("asked", F.lit(False))
    parts = F.col("key"), F.col("i"), F.col("j")
    light = "key bigint, node bigint, n bigint, comp bigint, out boolean, asks boolean, asked boolean, regs binary, i bigint, j bigint"
    names = [c.split()[0] for c in light.split(", ")]

    def meetings(group: list[tuple], parent: dict[int, int]) -> Iterator[tuple]:
        """For each asking row of one block: it, its component, the asked rows, their components, the plausible ones, best first.

        group: rows as in `light`. parent: components that were joined to others, as the caller finds links.
        """
        asking, all_ = [r for r in group if r[5]], [r for r in group if r[6]]
        if not asking or not all_:
            return
        key = group[0][0]
        regs = np.frombuffer(b"".join(r[7] for r in all_), np.uint16).reshape(-1, FINE)
        node, n, comp = (np.array([r[c] for r in all_], np.int64) for c in (1, 2, 3))
        out = np.array([r[4] for r in all_], bool)
        keys = np.stack([band_keys(r) for r in regs])
        # Two sets of that similarity agree in so many registers at least, by far.
        agree = least - 5 * (least * (1 - least) / FINE) ** 0.5
        for row in asking:
            _, own, own_n, now = row[:4]
            mine = np.frombuffer(row[7], np.uint16)
            while now in parent:
                now = parent[now]
            fits = least * np.maximum(n, own_n) <= np.minimum(n, own_n) + 1e-9
            at = np.flatnonzero((comp != now) & fits & (~out | (node > own)))  # comp: as joined so far
            at = at[(mine == regs[at]).sum(1) >= agree * FINE]
            if not len(at):
                continue
            shared = keys[at] == band_keys(mine)
            at = at[keys[at, shared.argmax(1)] == key]
            more, less = (mine > regs[at]).sum(1).astype(float), (mine < regs[at]).sum(1).astype(float)
            best, keep = likely(more, less, np.full(len(at), float(own_n)), n[at].astype(float), least, FINE, FINE_SLACK)
            yield row, now, all_, comp, at[keep][np.argsort(-best[keep], kind="stable")]

    def plausible(group: list[tuple]) -> Iterator[tuple]:
        """The rows of a block that have a plausible partner in it."""
        chosen = {}
        for row, _, all_, _, at in meetings(group, {}):
            for r in [row, *(all_[k] for k in at)] if len(at) else ():
                chosen[r[1]] = r
        yield from chosen.values()

    def linked(group: list[tuple]) -> Iterator[tuple[int, int]]:
        """The links of a block, by full sets of hashes, that join two components."""
        parent: dict[int, int] = {}
        for row, now, all_, comp, at in meetings(group, parent):
            h = np.frombuffer(row[-1], np.uint64)
            for k in at:
                if comp[k] == now:
                    continue
                same = len(np.intersect1d(h, np.frombuffer(all_[k][-1], np.uint64), assume_unique=True))
                if 100 * same >= percent * (len(h) + all_[k][2] - same):
                    yield min(row[1], all_[k][1]), max(row[1], all_[k][1])
                    parent[int(comp[k])] = now
                    comp[comp == comp[k]] = now

    def by_block(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """fn over the rows of each block; the blocks follow each other in a sorted partition."""
        types = [_arrow(f.split()[1]) for f in schema.split(", ")]
        fields = [f.split()[0] for f in schema.split(", ")]

        def batch_of(made: list) -> Iterator[pa.RecordBatch]:
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), types)], names=fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, group = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (row[0], row[8], row[9]) != last:
                        yield from batch_of(list(fn(group)))
                        last, group = (row[0], row[8], row[9]), []
                    group.append(row)
            yield from batch_of(list(fn(group)))

        return rows.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(run, schema)

    dealt = made_of(big.union(small), rows, "regs", fine).select(*names)
    chosen = ws.write(by_block(dealt, plausible, light))
    return by_block(made_of(chosen, chosen, "hashes", whole).select(*names, "hashes"), linked, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id_column, n_shingles, component_id (smallest id reachable over links), kept (it is its own component's id).

    Two documents are linked if 100 * intersection >= percent * union of their sets of `size`-word shingles.
    """
    least = percent / 100
    ws = Workspace(df.sparkSession, "near-dedup")
    docs = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("binary").alias("text"))
    all_sketches = ws.write(sketches(docs, "id", "text", size))
    nodes = ws.write(
        all_sketches.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    )

    buckets = ws.write(shared_buckets(nodes))
    candidates = ws.write(estimated(leader_pairs(buckets, percent), nodes, least))
    best = candidates.groupBy("b").agg(F.max_by("a", "est").alias("a")).select("a", "b")
    links = ws.write(confirmed(best, docs, size, percent))
    comps = components(ws, links)

    def rest(pairs: DataFrame, comps: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs across components that were not tried."""
        label = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
        apart = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))
        return apart.select(*pairs.columns).join(tried, ["a", "b"], "left_anti")

    more = ws.write(rest(candidates, comps, best))
    links2 = ws.write(confirmed(more, docs, size, percent))
    comps = components(ws, links2.union(comps.select(F.col("comp").alias("a"), F.col("node").alias("b"))))

    across = ws.write(across_links(ws, buckets, comps, docs, size, percent))
    links3 = ws.write(confirmed(across, docs, size, percent))
    comps = components(ws, links3.union(comps.select(F.col("comp").alias("a"), F.col("node").alias("b"))))

    classes = nodes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    out = ws.write(
        all_sketches.select("id", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .select(F.col("id").alias(id_column), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    )
    ws.drop_all_but(out)
    return out
