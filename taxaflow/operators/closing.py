"""Sets of terms closed over a graph inside tasks, many sets at once as the bits of words.

Each task is dealt all edges once, in a few packed rows, and its share of the sets, so neither a set's closure nor a pair of a
set and an ancestor is shuffled. What is shuffled is the sets themselves and the edges once for each task, of which there are
as many as cores take in two turns, BLOCKS at most; both grow with the input alone.

Sums of sets take each pair of a set and a node, from lists of what is at or above each own term, where these are short beside the
nodes of a batch. Where they are not, and where closed sets are asked for, a node has a bit for each set of a batch. Words go up the edges,
those of nodes without children first, so that each edge is taken once for 64 sets. Only nodes at or above a term of the batch have words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tasks at most, and rows that make another task worth its copy of the edges.
BLOCKS, ROWS = 96, 2000
#: Rows that edges are packed into; terms and rows of the sets that are closed together; sums that a task holds.
PACKS, TERMS_AT_ONCE, ROWS_AT_ONCE, HELD = 64, 30_000, 4096, 4_000_000
#: Bits of a node's number in a key of a group and a node; bytes of words that are held at once.
BITS, WORDS_BYTES = 32, 32 << 20
#: Sets of a group from which its sums are read byte by byte, not pair by pair.
LARGE_GROUP = 32
#: Places of lists that a task keeps from batch to batch, pairs that are summed at once, terms whose lists are made together. Pairs
#: are taken while there are fewer than one for so many places of a table of sets and nodes, which the bits fill, and while lists
#: have fewer places than LONG in the mean and take fewer steps than LONG_WAY.
LISTED, PAIRS, LISTED_AT_ONCE, SPARSE, LONG, LONG_WAY = 1 << 25, 1 << 21, 2048, 64, 1024, 128
#: A group with more than one for so many nodes of the graph among its sums has a place for each node, while its rows come.
WIDE = 32
#: The bits of each byte.
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


class Graph:
    """Nodes by number; the parents of node i are parents[starts[i] : starts[i + 1]]. Edges are sorted by level and parent.

    Children are on lower levels than their parents, but for nodes in or above a cycle, which are all on the last level.
    """

    def __init__(self, child: np.ndarray, parent: np.ndarray):
        self.values = np.unique(np.concatenate([child, parent]))
        self.index, self.mixed = pd.Index(self.values), False
        pairs = np.unique((self.index.get_indexer(child).astype(np.int64) << BITS) | self.index.get_indexer(parent))
        children, self.parents = pairs >> BITS, pairs & ((1 << BITS) - 1)
        self.starts = np.searchsorted(children, np.arange(len(self.values) + 1))
        level, self.cyclic = self._levels()
        self.long, self.lists = False, np.zeros(0, dtype=np.int32)
        self.list_begin = self.list_length = np.zeros(0, dtype=np.int64)
        order = np.lexsort((self.parents, level[children]))
        self.child, self.parent, self.level = children[order], self.parents[order], level[children][order]

    def _levels(self) -> tuple[np.ndarray, int]:
        waiting = np.bincount(self.parents, minlength=len(self.values))
        level = np.full(len(self.values), -1)
        at, depth = np.flatnonzero(waiting == 0), 0
        while at.size:
            level[at] = depth
            above, times = np.unique(self.above(at), return_counts=True)
            waiting[above] -= times
            at, depth = above[waiting[above] == 0], depth + 1
        level[level < 0] = depth
        return level, depth

    def above(self, at: np.ndarray) -> np.ndarray:
        """The parents of each node."""
        count = self.starts[at + 1] - self.starts[at]
        return self.parents[np.repeat(self.starts[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())]

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Terms that no edge has become nodes without parents."""
        found = self.index.get_indexer(terms)
        if (found < 0).any():
            more = np.unique(terms[found < 0])
            self.values, self.mixed = np.concatenate([self.values, more]), True
            self.index = pd.Index(self.values)
            self.starts = np.concatenate([self.starts, np.full(len(more), self.starts[-1])])
            found = self.index.get_indexer(terms)
        return found.astype(np.int64)

    def listed(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """begin and length, for each of these nodes, of the list of all nodes at or above it, and the lists; None if such lists are long."""
        if self.long:
            return None
        own = np.unique(node)
        if len(self.list_begin) < len(self.values):
            more = np.full(len(self.values) - len(self.list_begin), -1)
            self.list_begin, self.list_length = np.concatenate([self.list_begin, more]), np.concatenate([self.list_length, more])
        new = own[self.list_begin[own] < 0]
        made = self._lists(new)
        if len(self.lists) + sum(map(len, made)) > LISTED and len(new) < len(own):  # only those of now
            self.list_begin[:], self.lists, new = -1, self.lists[:0], own
            made = self._lists(new)
        if self.long:
            return None
        if new.size:
            length = self.list_length[new]
            self.list_begin[new] = len(self.lists) + np.cumsum(length) - length
            self.lists = np.concatenate([self.lists, *made])
        return self.list_begin[node], self.list_length[node], self.lists

    def _lists(self, node: np.ndarray) -> list[np.ndarray]:
        """The lists of some nodes one after another; their lengths are set."""
        lists: list[np.ndarray] = []
        for at in range(0, len(node), LISTED_AT_ONCE):
            some = node[at : at + LISTED_AT_ONCE]
            seen = new = (np.arange(len(some)) << BITS) | some
            steps = 0
            while new.size:
                of, last = new >> BITS, new & ((1 << BITS) - 1)
                above = np.unique((np.repeat(of, self.starts[last + 1] - self.starts[last]) << BITS) | self.above(last))
                place = np.minimum(np.searchsorted(seen, above), len(seen) - 1)
                new = above[seen[place] != above]
                seen = np.sort(np.concatenate([seen, new]))
                steps += 1
                if steps > LONG_WAY or len(seen) > LONG * len(some):
                    self.long = True
                    return []
            lists.append((seen & ((1 << BITS) - 1)).astype(np.int32))
            self.list_length[some] = np.bincount(seen >> BITS, minlength=len(some))
        return lists

    def closed(self, row: np.ndarray, node: np.ndarray, n_rows: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """nodes (by their values), a first word, words: bit b of words[w, k] says whether row 64 * (first + w) + b has nodes[k] at or above a node of its own."""
        inside = np.zeros(len(self.values), dtype=bool)
        at = np.unique(node)
        while at.size:
            inside[at] = True
            at = self.above(at)
            at = np.unique(at[~inside[at]])
        nodes = np.flatnonzero(inside)
        if self.mixed:
            nodes = nodes[np.argsort(self.values[nodes], kind="stable")]
        local = np.zeros(len(self.values), dtype=np.int64)
        local[nodes] = np.arange(len(nodes))
        chosen = inside[self.child]
        child, parent, level = local[self.child[chosen]], local[self.parent[chosen]], self.level[chosen]
        steps = []
        for some in np.split(np.arange(len(child)), np.flatnonzero(np.diff(level)) + 1):
            if some.size:
                firsts = np.flatnonzero(np.diff(parent[some], prepend=-1))
                steps.append((child[some], firsts, parent[some][firsts], level[some[0]] == self.cyclic))
        n_words, own = -(-n_rows // 64), local[node]
        size = max(1, WORDS_BYTES // (8 * max(1, len(nodes))))
        for first in range(0, n_words, size):
            words = np.zeros((min(size, n_words - first), len(nodes)), dtype=np.uint64)
            here = (row // 64 >= first) & (row // 64 < first + size)
            np.bitwise_or.at(words, (row[here] // 64 - first, own[here]), np.uint64(1) << (row[here] % 64).astype(np.uint64))
            for children, firsts, parents, again in steps:
                while True:
                    known = words[:, parents]
                    new = known | np.bitwise_or.reduceat(words[:, children], firsts, axis=1)
                    words[:, parents] = new
                    if not again or (new == known).all():
                        break
            yield nodes, first, words


def _members(words: np.ndarray, n_rows: int) -> Iterator[np.ndarray]:
    """The places of each row's nodes."""
    for k, word in enumerate(words):
        bits = np.unpackbits(word.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for bit in np.ascontiguousarray(bits.T[: min(64, n_rows - 64 * k)]).view(bool):
            yield np.flatnonzero(bit)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Graph, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The graph, some rows, and the row and number of each of their own terms. Edges come before rows."""
    edges: list[pa.StructArray] = []
    graph = None
    for batch in batches:
        is_edges = pc.is_valid(batch.column("__edges"))
        edges.append(batch.filter(is_edges).column("__edges"))
        rows = batch.filter(pc.invert(is_edges))
        if rows.num_rows == 0:
            continue
        if graph is None:
            terms = rows.column("terms").type.value_type
            ends = [np.concatenate([x.field(k).flatten().to_numpy(zero_copy_only=False) for x in edges]) for k in ("child", "parent")]
            empty = np.array([], dtype=np.int64 if pa.types.is_integer(terms) else object)
            graph, edges = Graph(*(x if x.size else empty for x in ends)), []
        sizes = pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < rows.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + TERMS_AT_ONCE, "right"))
            end = min(max(end, at + 1), at + ROWS_AT_ONCE, rows.num_rows)
            some = rows.slice(at, end - at)
            own = graph.numbers(some.column("terms").flatten().to_numpy(zero_copy_only=False))
            yield graph, some, np.repeat(np.arange(end - at, dtype=np.int64), sizes[at:end]), own
            at = end


def _dealt(sets: DataFrame, edges: DataFrame, share: Column, *by: str) -> DataFrame:
    """Rows of the sets, those of one group together, and the edges in each task before them (__edges, else null)."""
    most = min(BLOCKS, max(8, 2 * sets.sparkSession.sparkContext.defaultParallelism))
    blocks = min(most, 1 + sets.count() // ROWS)
    packs = edges.groupBy(F.pmod(F.xxhash64("child"), F.lit(PACKS))).agg(F.sort_array(F.collect_list(F.struct("child", "parent"))).alias("e"))
    packs = packs.select(F.struct(F.col("e.child").alias("child"), F.col("e.parent").alias("parent")).alias("__edges"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    both = packs.unionByName(sets.withColumn("__block", F.pmod(share.cast("bigint"), F.lit(blocks)).cast("int")), allowMissingColumns=True)
    return both.repartitionById(blocks, F.col("__block")).sortWithinPartitions(F.col("__edges").isNull(), *by)


def closed_sets(sets: DataFrame, edges: DataFrame, *key: str) -> DataFrame:
    """The rows (key, terms, any others) with all terms at or above their own, sorted; null terms are none.

    sets: read more than once, so a written table. edges: child, parent. key: columns by which rows are dealt to tasks.
    """
    schema = StructType([f for f in sets.schema.fields])
    names = schema.fieldNames()

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for graph, rows, row, own in _parts(batches):
            lists = [graph.values[:0]]
            for nodes, first, words in graph.closed(row, own, rows.num_rows):
                values = graph.values[nodes]
                lists += [values[places] for places in _members(words, rows.num_rows - 64 * first)]
            ends, kind = np.cumsum([len(x) for x in lists]), rows.column("terms").type
            terms = type_of(kind).from_arrays(pa.array(ends, type_offset(kind)), pa.array(np.concatenate(lists), kind.value_type), type=kind)
            yield pa.RecordBatch.from_arrays([terms if n == "terms" else rows.column(n) for n in names], names=names)

    return _dealt(sets, edges, F.xxhash64(*key)).mapInArrow(close, schema)


def type_of(kind: pa.DataType):
    return pa.LargeListArray if pa.types.is_large_list(kind) else pa.ListArray


def type_offset(kind: pa.DataType) -> pa.DataType:
    return pa.int64() if pa.types.is_large_list(kind) else pa.int32()


def _summed_by_pair(closed: Iterable, group: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted keys (group << BITS | node) and the sums of both weights of the group's rows that have the node: from each pair of a row and a node."""
    for nodes, first, words in closed:
        places = list(_members(words, len(group) - 64 * first))
        rows = np.repeat(np.arange(64 * first, 64 * first + len(places)), [len(x) for x in places])
        keys, at = np.unique((group[rows] << BITS) | nodes[np.concatenate(places)], return_inverse=True)
        yield keys, *(np.bincount(at, w[rows], len(keys)) for w in weights)


def _summed_by_list(graph: Graph, row: np.ndarray, node: np.ndarray, group: np.ndarray, weights: np.ndarray) -> list | None:
    """The same from the lists of the own terms; None if these are long, so that bits take less.

    Pairs are put in order by group, node and row in one number each, so those of a row that several of its terms give are neighbours.
    """
    if not row.size:
        return []
    found = graph.listed(node)
    if found is None:
        return None
    begin, length, lists = found
    total = np.cumsum(length)
    nodes = min(len(graph.values), length[np.unique(node, return_index=True)[1]].sum())  # at most
    if total[-1] * SPARSE > len(group) * nodes:
        return None
    out, at = [], 0
    row_bits, node_bits = int(len(group)).bit_length(), len(graph.values).bit_length()
    first = np.flatnonzero(np.diff(row, prepend=-1))  # of each row with terms
    while at < len(row):
        end = np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")
        end = len(row) if end >= len(row) else first[np.searchsorted(first, end, "right") - 1]
        if end <= at:  # a row with more than that
            next_ = np.searchsorted(first, at, "right")
            end = first[next_] if next_ < len(first) else len(row)
        n = length[at:end]
        place = np.repeat(begin[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = group[row[at]]
        pairs = np.repeat(((group[row[at:end]] - base) << (row_bits + node_bits)) | row[at:end], n) | (lists[place].astype(np.int64) << row_bits)
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        of, keys = pairs & ((1 << row_bits) - 1), pairs >> row_bits
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        keys = keys[begins]
        keys = (((keys >> node_bits) + base) << BITS) | (keys & ((1 << node_bits) - 1))
        out.append((keys, *(np.add.reduceat(w[of], begins) for w in weights)))
        at = end
    return out


def _summed_by_byte(closed: Iterable, group: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for rows whose groups begin at whole bytes: a byte of a node's words is looked up among the sums of its 256 values."""
    for nodes, first, words in closed:
        at, sums = -1, None
        for k, word in enumerate(words):
            octets = word.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                row = 64 * (first + k) + 8 * b
                if row >= len(group):
                    break
                if group[row] != at:
                    if sums is not None:
                        yield _found(at, nodes, sums)
                    at, sums = group[row], np.zeros((2, len(nodes)))
                eight = weights[:, row : row + 8]
                octet = np.ascontiguousarray(octets[:, b])
                for s, w in zip(sums, eight):
                    s += (_BITS_OF[:, : len(w)] @ w)[octet]
        if sums is not None:
            yield _found(at, nodes, sums)


def _found(group: int, nodes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = np.flatnonzero(sums[1])
    return (np.int64(group) << BITS) | nodes[some], sums[0][some], sums[1][some]


def closed_sums(sums: DataFrame, edges: DataFrame, node: str, by: list[str], share: Column) -> DataFrame:
    """by, node, quantity, n_peptides: the sums (by, terms, quantity, n_peptides) of all sets that have the node at or above a term.

    sums: read more than once, so a written table. share: rows of the same share are summed in one task before they leave it.
    """
    own = sums.schema["terms"].dataType.elementType.simpleString()
    kinds = [f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by]
    schema = ", ".join([*kinds, f"`{node}` {own}", "quantity double", "n_peptides bigint"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        graph, types = None, None
        # The wide group whose rows come now, and its sums, with a place for each node.
        wide, places = -1, np.zeros((2, 0))

        def merged() -> None:
            keys = np.concatenate([h[0] for h in held])
            order = np.argsort(keys, kind="stable")  # parts are in order
            keys = keys[order]
            begins = np.flatnonzero(np.diff(keys, prepend=-1))
            held[:] = [(keys[begins], *(np.add.reduceat(np.concatenate([h[k] for h in held])[order], begins) for k in (1, 2)))]

        def added(keys: np.ndarray, *sums: np.ndarray) -> Iterator[tuple]:
            """Keep sums whose keys are in order; those of a wide group come back when another one begins."""
            nonlocal wide, places
            begins = np.flatnonzero(np.diff(keys >> BITS, prepend=-1))
            narrow = np.ones(len(keys), dtype=bool)
            for begin, end in zip(begins, [*begins[1:], len(keys)]):
                if (end - begin) * WIDE <= len(graph.values):
                    continue
                if keys[begin] >> BITS != wide:
                    yield from unloaded()
                    wide, places = int(keys[begin] >> BITS), np.zeros((2, len(graph.values)))
                elif places.shape[1] < len(graph.values):
                    places = np.pad(places, ((0, 0), (0, len(graph.values) - places.shape[1])))
                node = keys[begin:end] & ((1 << BITS) - 1)
                for place, s in zip(places, sums):
                    place[node] += s[begin:end]
                narrow[begin:end] = False
            if narrow.any():
                held.append(tuple(x[narrow] for x in (keys, *sums)))

        def unloaded() -> Iterator[tuple]:
            nonlocal wide
            if wide >= 0:
                found, wide = _found(wide, np.arange(places.shape[1]), places), -1
                yield found

        def out(keys: np.ndarray, quantity: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names = list(groups)
            of = keys >> BITS
            columns = [pa.array([g[k] for g in names], t).take(pa.array(of)) for k, t in enumerate(types[:-1])]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(graph.values[keys & ((1 << BITS) - 1)], types[-1]), pa.array(quantity), pa.array(n.round().astype(np.int64))],
                names=[*by, node, "quantity", "n_peptides"],
            )

        for graph, rows, row, own in _parts(batches):
            types = types or [*(rows.column(c).type for c in by), rows.column("terms").type.value_type]
            tuples = list(zip(*(rows.column(c).to_pylist() for c in by))) if by else [()] * rows.num_rows
            group = np.array([groups.setdefault(t, len(groups)) for t in tuples], dtype=np.int64)
            weights = np.array([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("quantity", "n_peptides")])
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            found = _summed_by_list(graph, row, own, group, weights)
            if found is not None:
                pass
            elif len(begins) * LARGE_GROUP <= rows.num_rows:
                # Groups begin at whole bytes; the rows between have no terms and no weight.
                lengths = np.diff(begins, append=rows.num_rows)
                moved = np.cumsum(-lengths % 8) - (-lengths % 8)
                to = np.arange(rows.num_rows) + np.repeat(moved, lengths)
                group_at, weights_at = np.full(to[-1] + 1, -1), np.zeros((2, to[-1] + 1))
                group_at[to], weights_at[:, to] = group, weights
                found = _summed_by_byte(graph.closed(to[row], own, len(group_at)), group_at, weights_at)
            else:
                found = _summed_by_pair(graph.closed(row, own, rows.num_rows), group, weights)
            for sums in found:
                for whole in added(*sums):
                    yield out(*whole)
            if sum(len(h[0]) for h in held) > HELD:
                merged()
                if len(held[0][0]) > HELD // 2:
                    for whole in (*unloaded(), held.pop()):
                        yield out(*whole)
                    groups.clear()
        if held:
            merged()
        for whole in (*unloaded(), *held):
            yield out(*whole)

    rows = sums.select(*by, "terms", F.col("quantity").cast("double").alias("quantity"), "n_peptides", share.alias("__share"))
    parts = _dealt(rows, edges, F.col("__share"), *by).mapInArrow(add, schema)
    return parts.groupBy(*by, node).agg(F.sum("quantity").alias("quantity"), F.sum("n_peptides").alias("n_peptides"))
