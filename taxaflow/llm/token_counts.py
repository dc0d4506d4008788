"""Token counts without token ids: lengths are all that leaves the Python worker.

A text is cut at every safe boundary of the byte-level pre-splitting pattern, so a count is a sum over pieces.
Pieces recur, so each worker keeps the counts of those it has met (a bounded table) and gives only new ones
to the tokenizer, in batches of about the same number of bytes.
A null text counts as empty: no tokens. Bytes that are no UTF-8 count as U+FFFD (n_bytes as they are). Rows repeat as often as they do in the input; other columns are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .byte_bpe import SAFE
from .common import map_texts, worker_cache

#: Bytes of new pieces in one call of the tokenizer, about.
BATCH_BYTES = 1 << 18
#: Pieces whose counts a worker keeps, and their longest; then it starts afresh.
KEPT_PIECES, KEPT_LENGTH = 400_000, 256
#: Letters (Latin-1), then marks: the pattern always cuts between them.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding, on one thread: Spark has the other cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


class PieceCounts(dict):
    """Counts of pieces of text."""

    def __init__(self, path: str):
        super().__init__()
        self.own = tokenizer(path)

    def learn(self, pieces: Iterable[str]) -> None:
        """Count the new pieces among these."""
        new = {p for p in pieces if p not in self}
        if len(self) + len(new) > KEPT_PIECES:
            new = set(pieces)
            self.clear()
        parts = {p: PLAIN.fullmatch(p) for p in new}
        need = {q for p, m in parts.items() for q in (m.groups() if m else (p,)) if q and q not in self}
        batch: list[str] = []
        size = 0
        for piece in need:
            batch.append(piece)
            size += len(piece.encode())
            if size > BATCH_BYTES:
                self._count(batch)
                batch, size = [], 0
        self._count(batch)
        for piece, match in parts.items():
            if match and piece not in self:
                self[piece] = sum(self[q] for q in match.groups() if q)

    def _count(self, batch: list[str]) -> None:
        if batch:
            for piece, got in zip(batch, self.own.encode_batch_fast(batch, add_special_tokens=False)):
                self[piece] = len(got)


def pieces(text: str) -> list[str]:
    """The text cut before every safe space."""
    first, *rest = SAFE.split(text)
    return [first, *[" " + x for x in rest]] if first or rest else []


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_bytes (of UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        known = worker_cache(("pieces", tokenizer_path), lambda: PieceCounts(tokenizer_path))
        for group in balanced(texts):
            cut = [pieces(t.decode(errors="replace")) for t in group]
            distinct = set().union(*cut)
            known.learn(distinct)
            for text, parts in zip(group, cut):
                n = sum(map(known.__getitem__, parts))
                yield len(text), n, n > limit
            for piece in distinct:
                if len(piece) > KEPT_LENGTH:
                    del known[piece]

    return map_texts(df, [id_column], text_column, "n_bytes bigint, n_tokens bigint, over_limit boolean", run)


def balanced(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in order, in groups of about `size` bytes."""
    group: list[bytes] = []
    total = 0
    for text in texts:
        group.append(text)
        total += len(text)
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group
