"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bulk-synchronous best-fit. A piece longer than half the capacity shares its sequence with no other such piece, so each
opens one; what it leaves free is a gap. Then rounds follow until every piece has its place:

1. Open. For each length l, the pieces of l or more and the gaps of l or more tell how many further sequences are needed
   at least; the largest such number is opened. (The driver sees counts by size: at most 2 * capacity numbers.)
2. Sort. Gaps and pieces are sorted together by size, large ones first and gaps before pieces of their size, by a range
   partitioning whose ties are broken by hash, so one length may fill many tasks.
3. Sweep. Gaps count +1 and pieces -1. The running sum is worked out inside each range and shifted by the sums of the
   ranges before it. The rank that it gives settles all conflicts: a piece takes the last gap of its own level, which
   is the smallest gap that no other piece takes. A level is crossed at most once a size in either direction,
   so a level has at most 2 * capacity rows.
4. Update. Gaps shrink by what they took; pieces that found none wait for the next round.

A gap may stand for several equal parts of itself, each no smaller than the longest waiting piece, so that a gap takes
many short pieces in one round. Every table of a round is written, so a lost executor costs one round at most.

A null text counts as empty: one piece with the end mark only. Bytes that are no UTF-8 count as U+FFFD. Rows that
repeat an id are separate documents with equal columns; other columns are left out. Pieces keep no order in sequences.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, map_texts, worker_cache
from .token_counts import balanced, tokenizer

#: Words whose ids a worker keeps (some 200 bytes each); then it starts afresh.
KEPT_WORDS = 300_000
#: Words that the tokenizer gets in one text.
JOINED = 2048
_LATIN = {kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
#: White space as the tokenizer's normaliser sees it; str.split would also cut at U+001C to U+001F.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: what the tokenizer's pre-splitting pattern matches in lower-case text of code points under 256.
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN['L']}]+|[{_LATIN['N']}]|[^{_SPACE}{_LATIN['L']}{_LATIN['N']}]+")
LETTERS = re.compile(rf"[{_LATIN['L']}]+")
WORDS = re.compile(f"[^{_SPACE}]+")


class WordIds(dict):
    """Ids of words without white space, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        super().__init__()
        self.own = tokenizer(path)
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        new = words - self.keys()
        if len(self) + len(new) > KEPT_WORDS:
            new = words
            self.clear()
        plain, other = [], []
        for word in new:
            (plain if LETTERS.fullmatch(word) else other).append(word)
        for at in range(0, len(plain), JOINED):
            self._joined(plain[at : at + JOINED])
        for at in range(0, len(other), JOINED):
            self._single(other[at : at + JOINED])

    def _joined(self, words: list[str]) -> None:
        """Words of letters only: each ends with the one token that ends a word, so one text can hold many of them."""
        ids = np.array(self.own.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._single(words)
        data, start = ids.tobytes(), 0
        for word, stop in zip(words, (4 * stops).tolist()):
            self[word] = data[start:stop]
            start = stop

    def _single(self, words: list[str]) -> None:
        for word, got in zip(words, self.own.encode_batch_fast(words, add_special_tokens=False)):
            self[word] = np.array(got.ids, "<u4").tobytes()


def split_words(text: str) -> list[str]:
    """What a text's ids are looked up by: its lower-case pre-tokens, or its words where other rules may apply."""
    if "<|" in text or (not text.isascii() and max(text) > "\xff"):
        return WORDS.findall(text)
    return LATIN.findall(text.lower())


def cut_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """id_column, piece (from 0), start, length, ids_crc32 of each piece; with keep_ids also ids.

    A document's tokens end with end_id; only documents longer than capacity are cut.
    """
    schema = "lengths array<bigint>, crcs array<bigint>" + ", ids array<binary>" * keep_ids

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        known = worker_cache(("words", tokenizer_path), lambda: WordIds(tokenizer_path))
        last = np.array([end_id], "<u4").tobytes()
        for group in balanced(texts):
            cut = [split_words(t.decode(errors="replace")) for t in group]
            known.learn(set().union(*cut))
            for words in cut:
                data = b"".join(map(known.__getitem__, words)) + last
                parts = [data[at : at + 4 * capacity] for at in range(0, len(data), 4 * capacity)]
                yield ([len(p) // 4 for p in parts], [zlib.crc32(p) for p in parts]) + ((parts,) if keep_ids else ())

    made = map_texts(df, [id_column], text_column, schema, run)
    names = ["lengths", "crcs"] + ["ids"] * keep_ids
    rows = made.select(id_column, F.posexplode(F.arrays_zip(*names)))
    columns = [F.col("pos").alias("piece"), (F.col("pos").cast("bigint") * capacity).alias("start"), F.col("col.lengths").alias("length"), F.col("col.crcs").alias("ids_crc32")]
    return rows.select(id_column, *columns, *[F.col("col.ids").alias("ids")] * keep_ids)


def sequences_needed(waiting: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many sequences the waiting pieces (length: number) need at least besides the gaps (size: number)."""
    lengths = np.array(sorted(waiting), np.int64)
    number = np.array([waiting[x] for x in lengths.tolist()], np.int64)
    sizes = np.array(sorted(gaps), np.int64)
    there = np.array([gaps[x] for x in sizes.tolist()], np.int64)
    from_ = np.searchsorted(sizes, lengths)  # gaps that hold a piece of this length
    room = np.append(np.cumsum((sizes * there)[::-1])[::-1], 0)[from_]
    by_volume = -(-(np.cumsum((lengths * number)[::-1])[::-1] - room) // capacity)
    places = np.array([(sizes[k:] // x * there[k:]).sum() for x, k in zip(lengths.tolist(), from_)], np.int64)
    by_number = -(-(np.cumsum(number[::-1])[::-1] - places) // (capacity // lengths))
    return max(0, int(by_volume.max(initial=0)), int(by_number.max(initial=0)))


def swept(ws: Workspace, state: DataFrame, parts_of: int, longest: int) -> DataFrame:
    """(item, length, seq, free, before): the pieces that found a gap in one sweep. state: id, asks, size.

    before: the tokens of the pieces that go into the same gap before this one.
    """
    k = F.when(F.col("asks"), 1).otherwise(F.least(F.greatest(F.floor(F.col("size") / longest), F.lit(1)), F.lit(parts_of)))
    parts = state.withColumn("k", k.cast("bigint")).select("id", "asks", F.floor(F.col("size") / F.col("k")).cast("int").alias("size"), F.col("size").alias("free"), F.explode(F.sequence(F.lit(1).cast("bigint"), "k")).alias("part"))
    order = [F.desc("size"), F.asc("asks"), F.asc("tie"), F.asc("id"), F.asc("part")]
    rows = parts.withColumn("tie", F.xxhash64("id", "part")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("size", "asks", "id", "free", F.spark_partition_id().alias("range"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The running sum inside the range, and each row's place in it."""
        total = place = 0
        for batch in batches:
            step = np.where(batch.column("asks").to_numpy(zero_copy_only=False), -1, 1)
            level = total + np.cumsum(step)
            total = int(level[-1]) if len(level) else total
            at = np.arange(place, place + len(step))
            place += len(step)
            arrays = [*batch.columns, pa.array(level, pa.int64()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "level", "place"])

    rows = ws.write(rows.mapInArrow(summed, "size int, asks boolean, id bigint, free int, range int, level bigint, place bigint"))
    ends = rows.groupBy("range").agg(F.max_by("level", "place").alias("last"))  # one row for each range
    before = F.coalesce(F.sum("last").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(ends.select("range", before.alias("before"))), "range")
    rows = rows.withColumn("level", F.col("level") + F.col("before") + F.col("asks").cast("int"))
    last = F.lag(F.struct("asks", "id", "free")).over(Window.partitionBy("level").orderBy("range", "place"))
    found = rows.withColumn("last", last).where("asks and not last.asks")
    found = found.select(F.col("id").alias("item"), F.col("size").alias("length"), F.col("last.id").alias("seq"), F.col("last.free").alias("free"))
    # A gap takes at most as many pieces as it had parts, so a window is small.
    inside = F.sum("length").over(Window.partitionBy("seq").orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    return ws.write(found.withColumn("before", F.coalesce(inside, F.lit(0)).cast("int")))


def pack(ws: Workspace, pieces: DataFrame, capacity: int) -> DataFrame:
    """item, sequence_id, offset of every piece. pieces: item (distinct, not negative), length (1 to capacity)."""
    alone = F.col("length") * 2 > capacity
    placed = [pieces.where(alone).select("item", F.col("item").alias("sequence_id"), F.lit(0).alias("offset"))]
    # Gaps (id: the sequence, size: what is free) and waiting pieces (id: the item, size: the length).
    size = F.when(alone, capacity - F.col("length")).otherwise(F.col("length")).cast("int")
    state = ws.write(pieces.select(F.col("item").alias("id"), (~alone).alias("asks"), size.alias("size")).where("size > 0"))
    opened = 0
    while True:
        sizes = state.groupBy("asks", "size").count().collect()  # at most 2 * capacity rows
        asked = {r["size"]: r["count"] for r in sizes if r["asks"]}
        if not asked:
            break
        least = min(asked)
        there = {r["size"]: r["count"] for r in sizes if not r["asks"] and r["size"] >= least}
        if new := sequences_needed(asked, there, capacity):
            fresh = ws.spark.range(opened, opened + new).select((-1 - F.col("id")).alias("id"), F.lit(False).alias("asks"), F.lit(capacity).alias("size"))
            state, opened = state.unionByName(fresh), opened + new
        state = state.where(F.col("size") >= least)
        found = swept(ws, state, -(-sum(asked.values()) // (sum(there.values()) + new)), max(asked))
        placed.append(found.select("item", F.col("seq").alias("sequence_id"), (capacity - F.col("free") + F.col("before")).cast("int").alias("offset")))
        taken = found.groupBy(F.col("seq").alias("id")).agg(F.sum("length").alias("taken")).withColumn("asks", F.lit(False))
        gone = found.select(F.col("item").alias("id"), F.col("length").cast("bigint").alias("taken"), F.lit(True).alias("asks"))
        left = (F.col("size") - F.coalesce("taken", F.lit(0))).cast("int")
        state = ws.write(state.join(taken.unionByName(gone), ["id", "asks"], "left").select("id", "asks", left.alias("size")).where(F.col("size") >= least))
        ws.drop_all_but(pieces, state, *placed)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def best_fit(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document."""
    ws = Workspace(df.sparkSession, "packing")
    cut = cut_pieces(df, tokenizer_path, capacity, end_id, id_column, text_column)
    # Written once, so the numbers stay as they are.
    pieces = ws.write(cut.select("*", F.monotonically_increasing_id().alias("__item")))
    places = pack(ws, pieces.select(F.col("__item").alias("item"), "length"), capacity).withColumnRenamed("item", "__item")
    out = ws.write(pieces.join(places, "__item").select(*cut.columns, "sequence_id", F.col("offset").cast("bigint").alias("offset")))
    ws.drop_all_but(out)
    return out
