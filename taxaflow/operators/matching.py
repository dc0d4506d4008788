"""Which patterns occur in which texts: two strategies with equal results.

`contains` sends the patterns to every task and tests each text: for very few patterns. `seed` joins each pattern's rarest
stretch with the texts' stretches, and verifies the whole pattern where its stretch was found. All stretches are of bytes
of UTF-8, in which a text has a pattern just where it has its letters:

1. A seed is as long as the pattern, or longer than two thirds of it, as there are few sizes of seeds: the longer a stretch, the rarer
   it is. Seeds of very long patterns have MOST_SEED bytes.
2. Texts are cut into overlapping pieces, so that no step depends on how long a text is. Tasks look up the stretches of each
   size at every place of a piece in a filter of bits (as of a Bloom filter), so only those that may be a seed are made into rows.
3. A pattern as long as its seed is met by that seed. The stretches of the others are counted over those of all texts, and
   each pattern takes its rarest one.
4. Chosen seeds join the texts' stretches. One whose occurrences times patterns are many is dealt to several tasks on the texts'
   side (salted), so neither a common stretch nor many patterns that share one make a large task.
5. The bytes around an occurrence travel with it, and hold all of a pattern of ordinary length. Only candidates of longer
   patterns join their text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..functions.text import upper_letters
from ..plans.tables import written

#: Patterns, and bytes of them, up to which they are broadcast and tested one by one.
FEW_PATTERNS, FEW_BYTES = 8, 1 << 16
#: Bytes of a seed at most; letters of a piece's own part; bytes around a seed on either side.
MOST_SEED, PIECE, AROUND = 64, 1 << 15, 64
#: Bytes of texts (as the optimizer estimates them) up to which they are dealt to all cores first, as such a table is one file or row group.
SMALL_BYTES = 1 << 28
#: Seeds up to which a filter is broadcast (16 bits each and more, up to 2 ** MOST_BITS in all) to leave out stretches that are none of them.
BROADCAST_SEEDS, MOST_BITS = 500_000_000, 30
#: Places whose stretches are looked up at once; stretches that a task holds; a task fills chunks of 2 ** CHUNK bits of the filter.
PLACES, HELD, CHUNK = 1 << 16, 1_000_000, 15
#: Occurrences times patterns of a seed in one task, at least; and how many parts of all of them a task may hold.
CELL, PARTS = 200_000, 1000
#: Odd factors of the hashes; the inverse of the first.
_BASE, _MIX, _AGAIN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


def matches(patterns: DataFrame, texts: DataFrame, strategy: str = "auto") -> DataFrame:
    """peptide, protein_id: each pair once where the text (sequence, in upper case) contains the pattern.

    patterns: peptide. texts: protein_id, sequence. Empty patterns and nulls match nothing.
    """
    patterns = patterns.select("peptide").where("peptide <> ''")
    texts = texts.select("protein_id", upper_letters(F.col("sequence")).alias("sequence")).where("sequence is not null")
    if strategy != "contains":
        patterns = written(patterns)  # looked at several times
    if strategy == "auto":
        some = patterns.limit(FEW_PATTERNS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("peptide")).alias("bytes")).first()
        strategy = "contains" if some.n <= FEW_PATTERNS and (some.bytes or 0) <= FEW_BYTES else "seed"
    return {"contains": by_contains, "seed": by_seed}[strategy](patterns, texts).distinct()


def by_contains(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """For patterns whose number and size have been checked."""
    found = texts.join(F.broadcast(patterns), F.contains("sequence", "peptide"))
    return found.select("peptide", "protein_id")


def dealt(texts: DataFrame) -> DataFrame:
    """The texts on all cores, if they are few and in fewer files."""
    size, cores = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if size <= SMALL_BYTES and len(texts.inputFiles()) < cores else texts


def pieces(texts: DataFrame) -> DataFrame:
    """protein_id, piece: pieces with PIECE letters of their own, and so many more that each seed is somewhere with all that is around it."""
    number = F.greatest(F.floor((F.length("sequence") - 1) / PIECE), F.lit(0)).cast("int")
    rows = texts.where("sequence <> ''").select("protein_id", "sequence", number.alias("last"))
    rows = rows.select("protein_id", "sequence", "last", F.explode(F.sequence(F.lit(0), "last")).alias("k"))
    cut = F.substring("sequence", F.col("k") * PIECE + 1, F.lit(PIECE + MOST_SEED + 2 * AROUND))
    return rows.select("protein_id", F.when(F.col("last") == 0, F.col("sequence")).otherwise(cut).alias("piece"))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    """2 ** bits powers of the base, modulo 2 ** 64."""
    return np.cumprod(np.where(np.arange(1 << bits) == 0, np.uint64(1), np.uint64(base)))


def _sums(data: np.ndarray) -> np.ndarray:
    """What hashes of stretches of these bytes are differences of, up to a power of the base."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * _powers(_BASE, len(data).bit_length())[: len(data)], out=out[1:])
    return out


def _mixed(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MIX)


def _first_bit(mixed: np.ndarray, bits: int) -> np.ndarray:
    """Of the two bits of each hash in a filter of 2 ** bits."""
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _second_bit(mixed: np.ndarray, bits: int) -> np.ndarray:
    return _first_bit((mixed ^ (mixed >> np.uint64(32))) * np.uint64(_AGAIN), bits)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and the last one ends."""
    column = column.cast(pa.large_binary())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data else np.zeros(0, dtype=np.uint8)
    return data, starts - starts[0]


def _cut(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """data[first : last] of each."""
    size = last - first
    ends = np.concatenate([[0], np.cumsum(size)])
    out = data[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def seed_filter(seeds: DataFrame) -> Broadcast | None:
    """Bits of which each seed (seed, binary) has its two set; None if the seeds are too many for one."""
    n = seeds.count()
    if n > BROADCAST_SEEDS:
        return None
    bits = min(MOST_BITS, max(CHUNK, (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _flat(batch.column(0))
            sums = _sums(data)
            mixed = _mixed((sums[starts[1:]] - sums[starts[:-1]]) * _powers(_INVERSE, len(data).bit_length())[starts[:-1]])
            for bit in (_first_bit, _second_bit):
                yield pa.RecordBatch.from_arrays([pa.array(bit(mixed, bits).astype(np.int32))], names=["at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << (bits - CHUNK), (1 << CHUNK) // 8), dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(out.reshape(-1), at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        chunks = np.flatnonzero(out.any(axis=1))
        for some in np.array_split(chunks, -(-len(chunks) // 1000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in out[some]], pa.binary())], names=["chunk", "bits"])

    # Each chunk is filled by one task; the driver gets them once, 2 ** MOST_BITS bits at most.
    chunks = seeds.mapInArrow(places, "at int").repartition(F.shiftright("at", CHUNK)).mapInArrow(packed, "chunk bigint, bits binary")
    out = np.zeros((1 << (bits - CHUNK), (1 << CHUNK) // 8), dtype=np.uint8)
    for r in chunks.collect():
        out[r.chunk] = np.frombuffer(r.bits, dtype=np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(out.ravel())


def text_stretches(texts: DataFrame, sizes: list[int], those: Broadcast | None, around: bool = False) -> DataFrame:
    """The stretches of these sizes that the filter lets through. seed, ids, times: some texts (protein_id) that have it, each once, and how often all do.
    With around a row for each occurrence: protein_id, seed, before, around: how many bytes before it are in around, and the text from there to AROUND bytes
    behind it."""
    rows = pieces(texts)
    id_, seed = rows.schema["protein_id"], StructField("seed", BinaryType())
    if around:
        fields = [id_, seed, StructField("before", IntegerType()), StructField("around", BinaryType())]
    else:
        fields = [seed, StructField("ids", ArrayType(id_.dataType)), StructField("times", LongType())]
    return rows.mapInArrow(_looked_up(sizes, those, around), StructType(fields))


def _looked_up(sizes: list[int], those: Broadcast | None, around: bool) -> Callable:
    def found(data: np.ndarray, size: int, begin: int, sums: np.ndarray) -> np.ndarray:
        """Places from begin on, whose sums these are, of stretches that may be seeds."""
        n = min(PLACES, len(data) - begin - size + 1)
        if n <= 0 or those is None:
            return np.arange(begin, begin + max(n, 0))
        bits = those.value
        mixed = _mixed((sums[size : size + n] - sums[:n]) * _powers(_INVERSE, PLACES.bit_length())[:n])
        places = np.arange(n)
        for bit in (_first_bit, _second_bit):
            at = bit(mixed, len(bits).bit_length() + 2)
            yes = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            places, mixed = places[yes], mixed[yes]
        return begin + places

    def grouped(some: list[pa.Table], ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """A row for each seed of these, so that one which many texts have moves once with their ids."""
        pairs = pa.concat_tables(some).group_by(["text", "seed"]).aggregate([([], "count_all")])
        pairs = pairs.append_column("id", ids.take(pairs["text"].combine_chunks()))
        out = pairs.group_by("seed").aggregate([("id", "list"), ("count_all", "sum")])
        yield from out.select(["seed", "id_list", "count_all_sum"]).rename_columns(["seed", "ids", "times"]).to_batches(max_chunksize=10_000)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _flat(batch.column(1))
            ids, held, n_held = batch.column(0), [], 0
            for begin in range(0, len(data), PLACES):
                sums = _sums(data[begin : begin + PLACES + MOST_SEED])
                for size in sizes:
                    at = found(data, size, begin, sums)
                    text = np.searchsorted(starts, at, side="right") - 1
                    inside = at + size <= starts[text + 1]
                    at, text = at[inside], text[inside]
                    if not len(at):
                        continue
                    seed = _cut(data, at, at + size)
                    if around:
                        first = np.maximum(at - AROUND, starts[text])
                        before, letters = pa.array((at - first).astype(np.int32)), _cut(data, first, np.minimum(at + size + AROUND, starts[text + 1]))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), seed, before, letters], names=["protein_id", "seed", "before", "around"])
                    else:
                        held.append(pa.table({"text": pa.array(text), "seed": seed}))
                        n_held += len(at)
                if n_held > HELD:
                    yield from grouped(held, ids)
                    held, n_held = [], 0
            if held:
                yield from grouped(held, ids)

    return rows


def by_seed(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """Joins on seeds; neither side has to fit in memory. patterns: from a written table, some more than once."""
    texts = dealt(texts)
    length = F.octet_length("peptide")
    rows = patterns.groupBy(F.least(length, F.lit(MOST_SEED + 1)).alias("length")).agg(F.max(length).alias("longest")).collect()
    lengths, sizes = {r.length for r in rows}, []
    if not rows:
        return patterns.crossJoin(texts.limit(0)).select("peptide", "protein_id")
    for n in sorted({min(n, MOST_SEED) for n in lengths}):
        if not sizes or 2 * n >= 3 * sizes[-1]:
            sizes.append(n)
    size = F.greatest(F.lit(0), *(F.when(length >= n, n) for n in sizes))
    found = []
    if whole := [n for n in sizes if n in lengths]:
        found.append(whole_matches(patterns.where(length == size), texts, whole))
    if len(lengths) > len(whole):
        found.append(long_matches(patterns.where(length > size).distinct().withColumn("size", size), texts, sizes, max(r.longest for r in rows)))
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def whole_matches(patterns: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """Patterns that are their own seeds."""
    there = text_stretches(texts, sizes, seed_filter(patterns.select(F.col("peptide").cast("binary").alias("seed"))))
    # Patterns move once, to be distinct and to be met. A task's share of them is small and needs no order.
    there = there.select(F.col("seed").cast("string").alias("peptide"), "ids").join(patterns.distinct().hint("shuffle_hash"), "peptide")
    return there.select("peptide", F.explode("ids").alias("protein_id"))


def rarest_seeds(patterns: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """peptide, seed, place, n: the stretch of `size` bytes of each pattern that the texts' stretches have least often (n times, but 0)."""
    own = patterns.withColumn("place", F.explode(F.sequence(F.lit(0), F.octet_length("peptide") - F.col("size"))))
    own = own.select("peptide", "place", F.substring(F.col("peptide").cast("binary"), F.col("place") + 1, F.col("size")).alias("seed"))
    there = text_stretches(texts, sizes, seed_filter(own.select("seed").distinct()))
    counts = there.groupBy("seed").agg(F.sum("times").alias("n"))
    entry = F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "place", "seed")
    rows = own.join(counts, "seed", "left").groupBy("peptide").agg(F.min(entry).alias("s"))
    return rows.select("peptide", "s.seed", "s.place", "s.n").where("n > 0")


def salts(chosen: DataFrame) -> DataFrame | None:
    """seed, parts of the seeds that several tasks share, PARTS at most; None if there is none."""
    cells = chosen.groupBy("seed").agg((F.first("n") * F.count("*")).alias("cells"), F.first("n").alias("n"))
    total = cells.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    share = max(CELL, total // PARTS)
    if total <= share:
        return None
    # A cell more than a share leaves at most PARTS seeds here.
    return cells.where(F.col("cells") > share).select("seed", F.least(F.ceil(F.col("cells") / share), F.col("n")).cast("int").alias("parts"))


def long_matches(patterns: DataFrame, texts: DataFrame, sizes: list[int], longest: int) -> DataFrame:
    """Patterns that are longer than their seeds (of `size` bytes)."""
    chosen = written(rarest_seeds(patterns, texts, sizes))
    there = text_stretches(texts, sizes, seed_filter(chosen.select("seed").distinct()), around=True)
    sides = ["seed"]
    if (hot := salts(chosen)) is not None:
        hot = F.broadcast(hot)
        parts = F.coalesce("parts", F.lit(1))
        there = there.join(hot, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("protein_id", "around", "before"), parts).cast("int")).drop("parts")
        chosen = chosen.join(hot, "seed", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        sides.append("salt")
    pairs = there.join(chosen, sides)
    # As much of the pattern as the bytes around the seed can tell.
    length, reach = F.octet_length("peptide"), F.octet_length("seed") + AROUND
    back = F.least("place", "before")
    seen = F.substring(F.col("around"), F.col("before") - back + 1, F.octet_length("around"))
    told = F.substring(F.col("peptide").cast("binary"), F.col("place") - back + 1, back + reach)
    whole = (F.col("place") <= F.col("before")) & (length - F.col("place") <= reach)
    begins = (F.col("place") <= F.col("before")) | (F.col("before") == AROUND)  # else the text begins after the pattern would
    pairs = pairs.where(begins & F.startswith(seen, told)).select("peptide", "protein_id", whole.alias("whole"))
    near = pairs.where("whole").select("peptide", "protein_id")
    if longest <= min(sizes) + AROUND:
        return near
    far = pairs.where("not whole").select("peptide", "protein_id").distinct()
    return near.unionByName(far.join(texts, "protein_id").where(F.contains("sequence", "peptide")).select("peptide", "protein_id"))


def unmatched(patterns: DataFrame, found: DataFrame) -> DataFrame:
    return patterns.join(found.select("peptide"), "peptide", "left_anti")


def matched(patterns: DataFrame, found: DataFrame) -> DataFrame:
    return patterns.join(found.select("peptide"), "peptide", "left_semi")
