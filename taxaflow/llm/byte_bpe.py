"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut where the pre-splitting pattern must start a new match, so that every piece encodes as it would
inside the whole text: before white space that follows another character, and between a letter and a plain mark. A
long run of white space is one match of the pattern but for its last character, which belongs to what follows; such a
match is encoded as it is, without the pattern, whose search would need a stack as deep as the run is long.

A null text counts as empty: no ids. Bytes that are no UTF-8 count as U+FFFD. Rows repeat as often as they do in the
input; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

#: A single space between characters that are not white space: no match of the pattern spans it.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: white space of the pre-splitting pattern. Python's own class has U+001C to U+001F besides.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a new match must start: at white space after another character; at a mark after a letter, both of plain kinds.
CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[.,;:!?\u3001\u3002\uff0c\uff01\uff1f])")
#: Characters of a long text that are encoded at once, about; characters of a long run of white space.
PIECE, RUN = 1 << 16, 512
ONE_MATCH = "(?s:.+)"
LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters; a piece is longer only where there is no safe boundary."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def matches_apart(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match of the pattern): the text in order."""
    at = 0
    for run in LONG_RUN.finditer(text):
        if run.start() > at:
            yield from ((x, False) for x in safe_pieces(text[at : run.start()], size))
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    if at < len(text):
        yield from ((x, False) for x in safe_pieces(text[at:], size))


def ids_of(ranks_path: str, pattern: str, text: str) -> Iterator[list[int]]:
    """The ids of a text, piece by piece."""
    own = encoding(ranks_path, pattern)
    for piece, is_match in matches_apart(text):
        yield (encoding(ranks_path, ONE_MATCH) if is_match else own).encode_ordinary(piece)


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer of a rank file, built once for each Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, ids (array<int>): the whole text's token ids."""

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        for text in texts:
            yield ([i for ids in ids_of(ranks_path, pattern, text.decode(errors="replace")) for i in ids],)

    return map_texts(df, [id_column], text_column, "ids array<int>", run)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id_column, bytes (binary): the raw bytes of the ids, which need not be whole UTF-8 characters. Null ids: null."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([df.schema[id_column], StructField("bytes", BinaryType())])

    def run(batches):
        own = encoding(ranks_path, pattern)
        for batch in batches:
            made = [None if ids is None else own.decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=schema.names)

    return df.select(id_column, ids_column).mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, then decode, each text where it lies, keeping digests only.

    id_column, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded bytes).
    """

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        own = encoding(ranks_path, pattern)
        for text in texts:
            n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in ids_of(ranks_path, pattern, text.decode(errors="replace")):
                ids_hash.update((" " * (n > 0) + " ".join(map(str, ids))).encode())
                bytes_hash.update(own.decode_bytes(ids))
                n += len(ids)
            yield n, ids_hash.hexdigest(), bytes_hash.hexdigest()

    return map_texts(df, [id_column], text_column, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
