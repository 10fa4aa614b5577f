"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file of a byte-level vocabulary is written out as a sentencepiece BPE
model: each token's bytes are mapped to one printable character per byte, its
score is its negative rank, and normalisation is the identity. Sentencepiece
merges the pair with the highest score first, leftmost on ties, which is the
merge order of the ranks; piece ids equal ranks. A text is cut into pre-tokens
by the vocabulary's pattern, each pre-token is encoded on its own, and decoding
looks the ids up in the inverse table.

Only the serialised model (its size is that of the vocabulary) is sent to the
executors; rows stay where they are, so there is no shuffle.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from asofspark.llm.common import column_of, text_of

CACHE_ENTRIES = 120_000
"""Pre-tokens a worker remembers before it starts its table anew."""
CACHE_CHARS = 48
"""Longer pre-tokens are not remembered."""
SLICE_CHARS = 2_000_000


def byte_characters() -> list[str]:
    """One printable character for each byte value.

    Bytes that print keep their own character; the others take the characters
    from code point 256 on, in order.
    """
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {b: chr(b) for b in printing}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model: ids are ranks, and one unknown piece follows them."""
    chars = byte_characters()
    normal, unknown, bpe, absent = 1, 2, 2, (1 << 64) - 1  # enum values and -1 of the public model format
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _block(1, _block(1, piece) + b"\x15" + struct.pack("<f", -rank) + _number(3, normal))
    out += _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, unknown))
    out += _block(2, _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, absent) + _number(42, absent) + _number(43, absent))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


def unicode_pattern(pattern: str) -> str:
    r"""The pattern with white space as Unicode defines it.

    Python's ``\s`` also takes the four separators U+001C to U+001F, which the
    vocabulary's own matcher does not.
    """
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class _Ids(dict):
    """Pre-token to its packed ids; misses are encoded."""

    def __init__(self, model: bytes, tokens: list[bytes]):
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.chars = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        self.whole = {t: i for i, t in enumerate(tokens)}

    def __missing__(self, pre_token: str) -> bytes:
        data = pre_token.encode()
        known = self.whole.get(data)
        ids = [known] if known is not None else self.encode(data.decode("latin-1").translate(self.chars))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(pre_token) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[pre_token] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        tokens = read_ranks(ranks_path)
        self._sent = spark.sparkContext.broadcast((sentencepiece_model(tokens), tokens))
        self._pattern = unicode_pattern(pattern)

    def encoder(self) -> Callable[[str | None], bytes]:
        """Text to ids as little-endian unsigned 32-bit integers; for use inside a task."""
        import regex

        cut, look = regex.compile(self._pattern).findall, _Ids(*self._sent.value).__getitem__
        return lambda text: b"".join(map(look, cut(text))) if text else b""

    def decoder(self) -> Callable[[bytes | None], bytes]:
        """Packed ids to the bytes they stand for; for use inside a task."""
        import numpy as np

        look = self._sent.value[1].__getitem__
        return lambda ids: b"".join(map(look, np.frombuffer(ids, "<u4").tolist())) if ids else b""


def encode_documents(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the packed ids of every whole text and the bytes they decode to.

    Null and empty texts have no ids. Every row is kept, equal rows too; an
    existing column named ``ids`` or ``decoded`` is replaced. Batches leave the
    worker in slices of about ``SLICE_CHARS`` characters, so its memory does not
    follow the batch size.
    """
    base = docs.drop(ids, decoded)
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec.encoder(), codec.decoder()
        for batch in batches:
            for part in slices(batch, at):
                packed = [encode(t) for t in part.column(at).to_pylist()]
                back = [decode(p) for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(packed, pa.binary()), pa.array(back, pa.binary())], names=[*part.schema.names, ids, decoded]
                )

    schema = StructType([*base.schema.fields, StructField(ids, BinaryType()), StructField(decoded, BinaryType())])
    return base.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``SLICE_CHARS`` of text, one row at least."""
    import pyarrow.compute as pc

    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        total += n
        if total >= SLICE_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def token_digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """One row per document: counts and digests of its ids and of the decoded bytes.

    A null text counts as empty: no ids, and digests of no bytes. Every row is
    answered, repeated ones too; an empty table gives no rows, and columns other than
    doc_id and text are not read, whatever their names.
    """
    out = encode_documents(docs.select(column_of(docs, "doc_id").alias("doc_id"), text_of(docs).alias("text")), codec)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
