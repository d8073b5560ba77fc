"""Byte-level BPE: whole texts to token ids and back, by a public rank file.

The tiktoken library merges bytes within each match of the split pattern. Its matcher overflows on
a single match of a million characters, so a long text is first cut where a match must end whatever
follows; a stretch without such a place is split by the pattern outside the library and each match
is merged alone. Ids are the same as for the uncut text.
"""
from __future__ import annotations

import base64
import functools
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

#: A text longer than this many code points is cut at safe boundaries.
CHUNK = 1 << 16

# Between these neighbours every match of the split pattern ends: no alternative of it spans a
# visible character followed by a space, or two classes of visible ASCII characters unless an
# apostrophe comes first, and it never looks behind.
_SAFE = regex.compile(
    r"(?<=[!-~])(?=[ \n])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])"
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (token in base 64, rank), loaded once in a process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in order, cut only at safe boundaries, each chunk the first such past ``size``."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str, size: int = CHUNK) -> list[int]:
    """Token ids of a whole text, without special tokens."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for chunk in chunks(text, size):
        if len(chunk) <= 4 * size:
            ids += enc.encode_ordinary(chunk)
            continue
        for match in regex.finditer(enc._pat_str, chunk):
            ids += enc._core_bpe.encode_single_piece(match.group().encode())
    return ids


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers, least byte first."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def from_little_endian(raw: bytes) -> list[int]:
    packed = array("I", raw)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tolist()


def encode_documents(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id",
                     text: str = "text", decode: bool = True) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens`` (long), ``ids`` (binary, little-endian 32 bits) and, with
    ``decode``, ``decoded``: the bytes that the ids stand for.

    Null and empty texts have no tokens. Repeated rows stay repeated, null ids stay null, and other
    columns of the frame are not read. One pass, no shuffle.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if decode else "")

    def build():
        enc = encoding(path, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, packed, back = [], [], []
            for value in batch.column("text"):
                ids = encode(enc, value.as_py())
                counts.append(len(ids))
                packed.append(little_endian(ids))
                if decode:
                    back.append(enc.decode_bytes(ids))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                       pa.array(packed, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if decode:
                columns.append(pa.array(back, pa.binary()))
                names.append("decoded")
            return pa.RecordBatch.from_arrays(columns, names)
        return run
    return map_arrow(rows, build, schema, "text")


def decode_documents(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id",
                     ids: str = "ids") -> DataFrame:
    """Per row of packed ids: ``doc_id`` and ``decoded``, the raw bytes. Null ids give no bytes."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(ids, F.lit(b"")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build():
        enc = encoding(path, pattern)

        def run(batch):
            back = [enc.decode_bytes(from_little_endian(v.as_py())) for v in batch.column("ids")]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "decoded"])
        return run
    return map_arrow(rows, build, f"doc_id {kind}, decoded binary", "ids")
