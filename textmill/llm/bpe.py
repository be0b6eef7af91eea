"""Byte-level BPE through a sentencepiece model that is written straight from a vocabulary.

The vocabulary is a file of ranks (base64 token, rank). Every byte is mapped to
one character, `chr(256 + byte)`, so each token becomes a piece of text; its
score is its negative rank, so the pair with the lowest rank merges first, and
normalisation is the identity. The model is serialised by hand (its format is
protocol buffers) and nothing is trained. Texts are cut by the pattern of the
vocabulary; each match is encoded on its own, and decoding maps ids back to the
bytes of their tokens.

Edge cases: a null text is encoded as an empty one, without ids. Special tokens
do not exist; their names are ordinary text. Long texts are encoded whole, match
by match. Repeated rows give equal rows, an empty table
none; extra columns are ignored.
"""

import base64
import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Fixed values of the sentencepiece model format: field numbers and enum values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
BPE = 2

# Matches that a worker keeps encoded; it starts anew beyond that.
REMEMBERED = 400_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank. Ranks have to be 0 to n - 1."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def to_characters(token: bytes) -> str:
    return "".join(chr(256 + byte) for byte in token)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _whole(field: int, value: int) -> bytes:
    return _number(field << 3) + _number(value)


def _sized(field: int, content: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(content)) + content


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the unknown piece comes last."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _sized(PIECES, _sized(1, text.encode()) + _number(2 << 3 | 5) + struct.pack("<f", score) + _whole(3, kind))

    pieces = b"".join(piece(to_characters(t), -float(i), NORMAL) for i, t in enumerate(tokens))
    pieces += piece("<unk>", 0.0, UNKNOWN)
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _whole(3, BPE) + _whole(4, len(tokens) + 1) + _whole(40, len(tokens)) + b"".join(_whole(f, absent) for f in (41, 42, 43))
    plain = _sized(1, b"identity") + _whole(3, 0) + _whole(4, 0) + _whole(5, 0)
    return pieces + _sized(TRAINER, trainer) + _sized(NORMALIZER, plain)


class Codec:
    """Encode and decode whole texts; made once in a task."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self._find = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._characters = {byte: 256 + byte for byte in range(256)}
        self._tokens = tokens
        self._ids: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        matches = self._find(text)
        distinct = set(matches)
        new = [m for m in distinct if m not in self._ids]
        if new:
            if len(self._ids) + len(new) > REMEMBERED:
                self._ids, new = {}, list(distinct)
            mapped = [m.encode().decode("latin-1").translate(self._characters) for m in new]
            self._ids.update(zip(new, self._model.encode(mapped, num_threads=1)))
        return list(chain.from_iterable(map(self._ids.__getitem__, matches)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document, the number of ids and the hashes of the ids and of the text decoded from them."""
    tokens = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes(tokens), tokens))  # as large as the vocabulary

    def run(batches):
        codec = Codec(*shared.value, pattern)
        names = [str(i) for i in range(len(codec._tokens))]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = codec.encode(text.as_py() or "")
                joined = ",".join(map(names.__getitem__, ids))
                out.append((
                    doc_id.as_py(), len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                    hashlib.sha256(codec.decode(ids)).hexdigest(),
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with its text encoded and decoded again; the columns stay. Null texts become empty."""
    tokens = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes(tokens), tokens))
    place = docs.columns.index("text")

    def run(batches):
        codec = Codec(*shared.value, pattern)
        for batch in batches:
            texts = (codec.decode(codec.encode(text.as_py() or "")).decode() for text in batch.column(place))
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded_sha256`, the hash of what they decode to."""
    tokens = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes(tokens), tokens))
    place = docs.columns.index("text")

    def run(batches):
        codec = Codec(*shared.value, pattern)
        for batch in batches:
            ids, hashes = [], []
            for text in batch.column(place):
                ids.append(np.array(codec.encode(text.as_py() or ""), np.int32))
                hashes.append(hashlib.sha256(codec.decode(ids[-1].tolist())).hexdigest())
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32()))).append_column("decoded_sha256", pa.array(hashes, pa.string()))

    more = [StructField("ids", ArrayType(IntegerType())), StructField("decoded_sha256", StringType())]
    return docs.mapInArrow(run, StructType([*docs.schema, *more]))
