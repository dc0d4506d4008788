"""Sharding by sampled splitters: shards of near-equal bytes, made of ranges of keys.

1. Key. A row's key is (hash of its text, hash of its id and of its place in the table): equal texts stand side by side, yet
   every row has a key of its own, so a group of copies of any size can be divided.
2. Sample. A row is drawn with a chance in proportion to its size (about SAMPLES for each range; larger rows count several times).
3. Boundaries. Weighted quantiles of the sampled keys cut the keys into RANGES ranges a shard, or more for tables of more than
   ROWS rows a range. They fall between texts.
4. Range partitioning. Each row finds its range by bisection of the boundaries; bytes and rows of each range are exact counts.
5. Subdivision. A range is overfull if it holds, besides its largest row, more than OVERFULL times its share. It is sampled
   again, in proportion to what it holds, and cut at quantiles of its own: between texts, or, if all its rows have one text,
   between rows; until no range is overfull.
6. Ranges go to shards, the largest first, each to the shard that has least. The driver sees a number of ranges that the
   parameters bound: about shards * RANGES + rows / ROWS.
7. A row's slot is the rows of the shard's ranges before its own, plus its place inside its range.

Only DataFrame functions. No task meets more than one range, and the text of a row is read once. Equal texts share a shard
unless they overfill a range by themselves.

A null text has no bytes: size OVERHEAD. Equal rows are rows of their own; a null id is an id. An empty table gives an empty
result. Columns that are not asked for are left out, whatever their names. A row larger than a shard's share fills a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Ranges for each shard, sampled rows for each range, rows of a range at most, times its share that a range may hold.
RANGES, SAMPLES, ROWS, OVERFULL = 32, 16, 2_000_000, 2.0
#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Rounds of subdivision at most; a few do, since one divides each overfull range by as many as it is overfull.
ROUNDS = 12
#: The least second key: a boundary with it falls between two texts.
LEAST = -(1 << 63)


def numbers(values: Iterable[int]) -> Column:
    """A constant array of longs."""
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries are not above the row's key (k1, k2), by bisection."""
    if not bounds:
        return F.lit(0)
    first, second = (numbers(x) for x in zip(*bounds))

    def step(at: Column, width: Column) -> Column:
        a, b = (F.get(x, at + width - 1) for x in (first, second))
        return F.when((a < F.col("k1")) | ((a == F.col("k1")) & (b <= F.col("k2"))), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]), F.lit(0), step)


def chance(salt: int) -> Column:
    """A number from 0 to 1 that a row's key and the round decide."""
    return F.pmod(F.xxhash64("k2", "k1", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def cuts(rows: DataFrame, salt: int, between_rows: bool = False) -> list[tuple[int, int]]:
    """Boundaries at each whole share of the load inside each range of rows (range, k1, k2, load), from a weighted sample.

    What fills a share by itself gets a range of its own. The sample is bounded, SAMPLES rows for each share, and so is
    what a range's window sorts.
    """
    drawn = rows.withColumn("weight", F.col("load") * SAMPLES).where(chance(salt) < F.col("weight"))
    names = ["k1", "k2"] if between_rows else ["k1"]
    units = drawn.groupBy("range", *names).agg(F.sum(F.greatest("weight", F.lit(1.0))).alias("weight"))
    order = Window.partitionBy("range").orderBy(*names)
    units = units.withColumn("at", F.floor(F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / SAMPLES))
    marked = units.withColumn("last", F.lag("at", 1, 0).over(order)).where((F.col("at") > F.col("last")) | (F.col("weight") >= SAMPLES))
    found = marked.select(*names, (F.col("weight") >= SAMPLES).alias("own")).collect()
    if between_rows:
        return [(r.k1, r.k2) for r in found]
    return [(r.k1, LEAST) for r in found] + [(r.k1 + 1, LEAST) for r in found if r.own and r.k1 != -LEAST - 1]


def dealt(loads: list[int], counts: list[int], shards: int) -> tuple[list[int], list[int]]:
    """(shard, rows of the shard's ranges before it) of each range: the largest first, each to the shard with least."""
    heap = [(0, 0, k) for k in range(shards)]
    shard_of, start = [0] * len(loads), [0] * len(loads)
    rows = [0] * shards
    for k in sorted(range(len(loads)), key=lambda k: (-loads[k], k)):
        load, n, shard = heapq.heappop(heap)
        shard_of[k] = shard
        heapq.heappush(heap, (load + loads[k], n + 1, shard))
    for k, shard in enumerate(shard_of):
        start[k] = rows[shard]
        rows[shard] += counts[k]
    return shard_of, start


def assign(df: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), ranges: int = RANGES, most_rows: int = ROWS) -> DataFrame:
    """id_column, size, text_crc32, shard (from 0), slot (from 0 in each shard, no gaps), range, and the carried columns in `row`."""
    ws = Workspace(df.sparkSession, "sharding")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    made = df.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_column), F.monotonically_increasing_id()).alias("k2"), *([F.struct(*carry).alias("row")] if carry else []),
    )
    keyed = ws.write(made)  # the keys stay as they are
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = max(1, shards * ranges, -(-n // most_rows))
    # What fills a range: its share of the bytes, or the rows that a range may hold.
    load = F.greatest(F.col("size") * (wanted / max(1, total)), F.lit(1.0 / most_rows))
    rows = keyed.select("k1", "k2", "size", load.alias("load"))
    bounds = cuts(rows.withColumn("range", F.lit(0)), 0)
    held: list[Row] = []
    for salt in range(1, ROUNDS):
        bounds = sorted({*bounds})
        found = rows.withColumn("range", range_of(bounds))
        sums = [F.sum("load").alias("load"), F.max("load").alias("most"), F.sum("size").alias("size"), F.count("*").alias("n"), (F.min("k1") == F.max("k1")).alias("one_text")]
        held = found.groupBy("range").agg(*sums).collect()
        overfull = {one: [r.range for r in held if r.load > OVERFULL + r.most and r.one_text == one] for one in (False, True)}
        new = [cut for one, which in overfull.items() if which for cut in cuts(found.where(F.col("range").isin(which)), salt, one)]
        if not any(overfull.values()):
            break
        bounds += new
    loads, counts = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for r in held:
        loads[r.range], counts[r.range] = r["size"], r.n
    shard_of, start = dealt(loads, counts, shards)
    place = F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2")) - 1
    out = keyed.withColumn("range", range_of(bounds))
    return out.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.get(numbers(shard_of), F.col("range")).cast("int").alias("shard"),
        (F.get(numbers(start), F.col("range")) + place).alias("slot"), "range", *(["row"] if carry else []),
    )


def write_shards(df: DataFrame, path: str, shards: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """All columns of df as Parquet below path, one folder for each shard (shard=0, ...), a file for each few ranges."""
    rows = assign(df, shards, id_column, text_column, tuple(df.columns)).select("shard", "slot", F.col("row"))
    rows.write.partitionBy("shard").parquet(path)
