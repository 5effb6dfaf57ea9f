"""Byte-level BPE by a sentencepiece model that is written out directly from a rank vocabulary.

Each byte maps to one printable code point, so a piece is a string of mapped bytes; its score is its negative rank, the
normaliser is the identity, and a merge of the best-scored pair, leftmost first, is then the merge of the lowest rank.
Pre-tokens come from the vocabulary's own pattern. Decoding is the inverse map. Both ways run per partition on Arrow
batches without any exchange; batches are worked on in slices of bounded bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.tables import table

#: Code point of byte 0; the block has no white space or special code points.
FIRST = 0x4E00
#: Pre-tokens whose ids a worker remembers, and the longest of them in characters.
REMEMBER, LONGEST = 120_000, 48
#: Characters of text that are encoded before results leave a worker.
CHUNK = 1_500_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, ints varints, floats 32-bit."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def mapped(raw: bytes) -> str:
    return "".join(chr(FIRST + b) for b in raw)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must be 0, 1, 2, … and cover every byte."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be dense and hold all bytes")
    return tokens


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer (2: BPE, no control pieces), normaliser (3: identity)."""
    pieces = [_field(1, mapped(t).encode()) + _field(2, float(-rank)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(tokens)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.byte = {b: chr(FIRST + b) for b in range(256)}
        self.whole = {t: np.array([k], dtype=np.int32).tobytes() for k, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.size, self.data = sizes, np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids, as bytes of 32-bit numbers, of pre-tokens that aren't remembered."""
        out, hard = {}, []
        for p in parts:
            raw = p.encode()
            if ids := self.whole.get(raw):
                out[p] = ids
            else:
                hard.append((p, "".join(map(self.byte.__getitem__, raw))))
        if hard:
            for (p, _), ids in zip(hard, self.model.encode([m for _, m in hard], num_threads=1), strict=True):
                out[p] = np.array(ids, dtype=np.int32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, split = self.known, [self.find(t) for t in texts]
        fresh = self.learn({p for parts in split for p in parts if p not in known})
        short = {p: ids for p, ids in fresh.items() if len(p) <= LONGEST}
        if len(known) + len(short) > REMEMBER:
            # what this call needs stays; the rest is learned again when it comes
            fresh |= {p: known[p] for parts in split for p in parts if p in known}
            known.clear()
            get = fresh.__getitem__
            if len(short) <= REMEMBER:
                known.update(short)
        elif len(short) == len(fresh):
            known.update(short)
            get = known.__getitem__
        else:
            known.update(short)
            get = lambda p: known[p] if p in known else fresh[p]
        return [np.frombuffer(b"".join(map(get, parts)), dtype=np.int32) for parts in split]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - sizes), sizes)
        return self.data[at]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _runs(weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(weights):
        end, held = at, 0
        while end < len(weights) and (end == at or held + weights[end] <= most):
            held += weights[end]
            end += 1
        yield at, end
        at = end


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with out_col: the ids of the text (array of int; null counts as empty, empty text has no ids). Rows stand alone: repeated ones each have their ids."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    schema = T.StructType([*(f for f in docs.schema if f.name != out_col), T.StructField(out_col, T.ArrayType(T.IntegerType(), False))])
    names = schema.names[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            sizes = [x or 0 for x in pa.compute.utf8_length(batch[text_col]).to_pylist()]
            for lo, hi in _runs(sizes, CHUNK):
                part = batch.slice(lo, hi - lo)
                ids = own.encode([t or "" for t in part[text_col].to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), lists], names=schema.names)

    return docs.mapInArrow(work, schema)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with out_col: the bytes that the ids stand for (null ids count as none). Rows stand alone."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    schema = T.StructType([*(f for f in docs.schema if f.name != out_col), T.StructField(out_col, T.BinaryType())])
    names = schema.names[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo, hi in _runs([x or 0 for x in pa.compute.list_value_length(batch[ids_col]).to_pylist()], CHUNK):
                part = batch.slice(lo, hi - lo)
                counts = np.array([x or 0 for x in pa.compute.list_value_length(part[ids_col]).to_pylist()], dtype=np.int64)
                ids = part[ids_col].flatten().to_numpy(zero_copy_only=False)
                held = np.concatenate([[0], np.cumsum(own.size[ids])])
                ends = held[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                data = pa.py_buffer(own.decode(ids).tobytes())
                out = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), data])
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), out], names=schema.names)

    return docs.mapInArrow(work, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
