"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library does the merges. Each match of the split pattern is encoded by itself and no
special token is recognised. A long text is first cut where the pattern always ends a match, so that
one call never sees more than ``max_chunk`` characters if such a place exists.

Where the pattern always ends a match: between a printable ASCII character and a following space or
line feed. No alternative of the pattern goes on from a non-space to white space, a match
never looks behind its start, and the only look-ahead (after white space) is not at such a place.
A text without one is encoded in one piece.

Cases: a null or empty text has no tokens; lone surrogates cannot occur in Spark strings; repeated
rows give repeated results; an empty table gives an empty result; columns other than the id and text
columns are ignored by ``bpe_digest`` and kept by ``bpe_encode``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pick, sha256_hex

#: Longest piece given to the library at once, in characters.
MAX_CHUNK = 20_000


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; executors get them with the task."""
    with open(path, "rb") as f:
        return f.read()


_CACHE: dict = {}


def encoder(ranks: bytes, pattern: str):
    """The tiktoken encoding of these ranks; one per worker process."""
    import tiktoken

    key = (hash(ranks), pattern)
    if key not in _CACHE:
        table = {}
        for line in ranks.split(b"\n"):
            if line.strip():
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        _CACHE[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _CACHE[key]


def safe_pieces(text: str, max_chunk: int = MAX_CHUNK) -> Iterator[str]:
    """``text`` in pieces that the pattern treats as it treats the whole."""
    start, n = 0, len(text)
    while n - start > max_chunk:
        at = start + max_chunk
        # back from the limit, then on from it
        while at > start and not _safe(text, at):
            at -= 1
        if at == start:
            at = start + max_chunk + 1
            while at < n and not _safe(text, at):
                at += 1
        yield text[start:at]
        start = at
    if start < n or not n:
        yield text[start:]


def _safe(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and "!" <= text[at - 1] <= "~"


def encode_text(enc, text: str | None, max_chunk: int = MAX_CHUNK) -> list[int]:
    if not text:
        return []
    if len(text) <= max_chunk:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, max_chunk):
        ids += enc.encode_ordinary(piece)
    return ids


def bpe_encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "token_ids", max_chunk: int = MAX_CHUNK, digest: str | None = None) -> DataFrame:
    """``df`` with an array<int> column ``out`` of token ids; with ``digest``, a column of that name has the SHA-256 of the bytes that the ids decode to."""
    held = df.sparkSession.sparkContext.broadcast(ranks)
    rest = [c for c in df.columns if c not in (out, digest)]
    schema = T.StructType([f for f in df.schema.fields if f.name in rest] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    if digest:
        schema = schema.add(digest, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [encode_text(enc, t, max_chunk) for t in part.column(at).to_pylist()]
                columns = [pa.array(ids, pa.list_(pa.int32()))]
                if digest:
                    columns.append(pa.array([sha256_hex(enc.decode_bytes(x)) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.fieldNames())

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the raw bytes that the ids stand for (null ids: null)."""
    held = df.sparkSession.sparkContext.broadcast(ranks)
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            raw = [None if x is None else enc.decode_bytes(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*rest, out])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def bpe_digest(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Per row: id, number of tokens, digest of the ids, digest of the decoded bytes.

    The ids go through the same encoder and decoder as ``bpe_encode`` and ``bpe_decode``, in one
    pass, so that neither ids nor decoded bytes leave the worker.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(held.value, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = encode_text(enc, t.as_py(), max_chunk)
                n.append(len(ids))
                a.append(sha256_hex(np.array(ids, "<u4").tobytes()))
                b.append(sha256_hex(enc.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(df, id_col, text).mapInArrow(run, schema)
