"""Language-model scores by context-tree weighting over bytes.

A text is read as its words, lower-cased, with one space between them and an end byte. Each byte is eight binary choices; each
choice, a node of the byte's binary tree, has its own tree of contexts of 0 to DEPTH preceding bytes. At every context a
Krichevsky-Trofimov estimate is mixed with the product of the longer contexts' mixtures, half and half, so all depths
are weighted by how well they coded the training texts. Scoring uses the trained tree as it stands.

Counts. Splits are fixed ranges of a file's rows. Each is reduced to packed arrays: its distinct byte runs of DEPTH + 1, grouped by their
last two context bytes, and its distinct token hashes, grouped by leading bits. A group's arrays are merged FAN at a time, round by round,
into one corpus-wide array, which grows with the corpus and is never broadcast; only the mixtures of contexts of one and no bytes (at most
256 * 256 numbers) travel with the code. Held-out texts take part with counts of zero: so the last array holds every run that any split
asks for, and is answered once. Answers go back down the same tree: each merged array hands its values to the at most FAN
arrays, or so, that it was made from. No array is copied for more. Each split's texts are then scored as a stream beside its own answers.
Texts are exchanged once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.tables import table, written
from sparkloom.llm.words import U, Words, slices

DEPTH = 5
END = 10
RUNS, TOKENS = 0, 1
#: Arrays that one merge or one answer takes together.
FAN = 64
#: Bytes of text of a split, keys that are answered at once, and the most partitions that splits are dealt to.
SPLIT, ONCE, TASKS = 16 << 20, 1 << 20, 1 << 17
#: Log probabilities are added up in steps of 1 / STEP.
STEP = 1 << 20
#: Leading bits of a token hash that make its group.
GROUP_BITS = 8
END_TOKEN = U(0xE17D0E17D0E17D07)
_I = np.arange(1, 7)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after six steps of the recurrence."""
    shift = np.zeros_like(x)
    for k in range(6):
        shift += np.log(x + k)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones, in any order, under the Krichevsky-Trofimov estimator."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the documents' words with single spaces and an end byte, and the bounds of each document."""
    size = words.end - words.start
    held = np.concatenate([[0], np.cumsum(size + 1)])
    empty = (words.count == 0).astype(np.int64)
    bounds = held[words.first] + np.concatenate([[0], np.cumsum(empty)])
    out = np.full(int(bounds[-1]), 32, dtype=np.uint8)
    at = held[:-1] + np.concatenate([[0], np.cumsum(empty)])[words.doc]
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + within] = words.data[np.repeat(words.start, size) + within]
    out[bounds[1:] - 1] = END
    return out, bounds


def runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A key for every byte of the streams, and the bounds of each document's keys.

    Two nearest context bytes on top, then the rest from near to far, then the byte itself.
    """
    data, bounds = stream(words)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    wide = data.astype(np.uint64)

    def back(d: int) -> np.ndarray:
        out = np.full(len(wide), END, dtype=np.uint64)
        out[d:] = wide[:-d] if d else wide
        out[place < d] = END
        return out

    key = wide.copy()
    for d, shift in ((1, 40), (2, 32), (3, 24), (4, 16), (5, 8)):
        key |= back(d) << U(shift)
    return key, bounds


def tokens(words: Words) -> np.ndarray:
    return words.hashes()


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, n = np.unique(keys[train], return_counts=True)
    other = np.unique(keys[~train])
    return _count([(own, n), (other, np.zeros(len(other), dtype=np.int64))])


def packed_counts(docs: DataFrame) -> DataFrame:
    """split, kind, grp, keys, counts: packed distinct runs and tokens of each split with their training counts."""
    schema = "split bigint, kind int, grp int, keys binary, counts binary"

    def rows(split: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for kind, shift in ((RUNS, 32), (TOKENS, 64 - GROUP_BITS)):
            keys, n = _count(held[kind])
            group = (keys >> U(shift)).astype(np.int64)
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
                own = keys[lo:hi] & U(0xFFFFFFFF) if kind == RUNS else keys[lo:hi]
                out.append((split, kind, int(group[lo]), _pack(own.astype(np.uint32) if kind == RUNS else own), _pack(n[lo:hi].astype(np.int64))))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["split", "kind", "grp", "keys", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            split = batch["split"].to_numpy()
            train = batch["train"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(split)) + 1).tolist(), len(split)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                if now is not None and split[first] != now:
                    yield from rows(now, held)
                    held = {}
                now = int(split[first])
                for lo, hi, words in slices(batch["text"].slice(first, last - first)):
                    own = train[first + lo : first + hi]
                    keys, bounds = runs(words)
                    ends = np.full(hi - lo, END_TOKEN, dtype=np.uint64)
                    every = np.concatenate([tokens(words), ends])
                    for kind, found in ((RUNS, _tally(keys, np.repeat(own, np.diff(bounds)))), (TOKENS, _tally(every, np.concatenate([own[words.doc], own])))):
                        held.setdefault(kind, []).append(found)
                        if len(held[kind]) >= 8:
                            held[kind] = [_count(held[kind])]
        if now is not None:
            yield from rows(now, held)

    return docs.mapInArrow(work, schema)


SHAPE = "kind int, grp int, slot bigint, keys binary, counts binary"


def merged(parts: DataFrame, splits: int) -> list[DataFrame]:
    """The levels of the merge tree: parts (slot: a hash of the split), then arrays of FAN or so of the level before, down to one a group.

    A level of n arrays a group is made from slots modulo n. Every key stays, whatever its count.
    """

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        kind = np.uint32 if key[0] == RUNS else np.uint64
        keys, n = _count([(_unpack(k, kind), _unpack(c, np.int64)) for k, c in zip(own["keys"], own["counts"], strict=True)])
        return pd.DataFrame({"kind": [key[0]], "grp": [key[1]], "slot": [key[2]], "keys": [_pack(keys)], "counts": [_pack(n)]})

    levels = [parts.withColumn("slot", F.pmod(F.xxhash64("split"), F.lit(1 << 30)))]
    for left in sizes(splits):
        below = levels[-1].select("kind", "grp", F.pmod("slot", F.lit(left)).alias("slot"), "keys", "counts")
        levels.append(written(below.groupBy("kind", "grp", "slot").applyInPandas(work, SHAPE)))
    return levels


def sizes(splits: int) -> list[int]:
    """How many arrays a group has on each level above the splits."""
    out = [-(-splits // FAN)]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


class Nodes:
    """One group's nodes at context depths 2 to DEPTH: (context, node) keys, zeros, ones and weights of the own estimate."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte, context = keys.astype(np.uint64) & U(255), keys.astype(np.uint64) >> U(8)
        key, a, b = [], [], []
        for bit in range(8):
            one = (byte >> U(7 - bit)) & U(1)
            key.append(context << U(8) | U(1 << bit) | byte >> U(8 - bit))
            a.append(np.where(one == 0, counts, 0))
            b.append(np.where(one == 1, counts, 0))
        key, at = np.unique(np.concatenate(key), return_inverse=True)
        a, b = (np.bincount(at, np.concatenate(x), minlength=len(key)) for x in (a, b))
        mixed = log_kt(a, b)
        self.levels = [(key, a, b, np.ones(len(key)))]
        for _ in range(DEPTH - 2):
            # drop the farthest byte, which is next to the node
            key, at = np.unique((key >> U(16)) << U(8) | key & U(255), return_inverse=True)
            a, b, below = (np.bincount(at, x, minlength=len(key)) for x in (a, b, mixed))
            own = log_kt(a, b)
            mixed = np.logaddexp(own, below) - np.log(2)
            self.levels.append((key, a, b, np.exp(own - np.logaddexp(own, below))))
        self.mixed = mixed

    def predict(self, keys: np.ndarray, near: tuple[np.ndarray, ...], last: int) -> np.ndarray:
        """log10 probability of each run's byte. near: weights and estimates of one at depths 1 and 0."""
        byte, context = keys.astype(np.uint64) & U(255), keys.astype(np.uint64) >> U(8)
        total = np.zeros(len(keys))
        w1, k1, w0, k0 = near
        for bit in range(8):
            node = U(1 << bit) | byte >> U(8 - bit)
            one = ((byte >> U(7 - bit)) & U(1)).astype(bool)
            p = np.full(len(keys), 0.5)
            for depth, (known, a, b, w) in zip(range(DEPTH, 1, -1), self.levels, strict=True):
                want = (context >> U(8 * (DEPTH - depth))) << U(8) | node
                at = np.minimum(np.searchsorted(known, want), max(len(known) - 1, 0))
                hit = known[at] == want if len(known) else np.zeros(len(want), dtype=bool)
                if not len(known):
                    continue
                kt = np.where(hit, (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1), 0.5)
                weight = np.where(hit, w[at], 0.5)
                p = weight * kt + (1 - weight) * p
            n = node.astype(np.int64)
            for w, k in ((w1[last, n], k1[last, n]), (w0[n], k0[n])):
                p = w * np.where(one, k, 1 - k) + (1 - w) * p
            total += np.log10(p)
        return total


def _learned(keys: bytes, counts: bytes, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys, and keys and counts of those that training texts hold."""
    every, n = _unpack(keys, kind), _unpack(counts, np.int64)
    return every, every[n > 0], n[n > 0]


def near_contexts(model: DataFrame) -> tuple[np.ndarray, ...]:
    """Own weights and estimates of one for contexts of one byte (256 x 256) and of none (256)."""
    schema = "last int, node int, a bigint, b bigint, mixed bigint"

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, keys, counts in zip(*(batch[c].to_pylist() for c in ("grp", "keys", "counts")), strict=True):
                _, own, n = _learned(keys, counts, np.uint32)
                if not len(own):
                    continue
                nodes = Nodes(own, n)
                key, a, b, _ = nodes.levels[-1]
                last = np.full(len(key), grp >> 8, dtype=np.int32)
                # whole multiples of a small step add up to the same sum in any order
                columns = (last, (key & U(255)).astype(np.int32), a.astype(np.int64), b.astype(np.int64), np.round(nodes.mixed * STEP).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["last", "node", "a", "b", "mixed"])

    sums = model.filter(f"kind = {RUNS}").select("grp", "keys", "counts").mapInArrow(second, schema).groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("a", "b", "mixed")))
    a, b, below = (np.zeros((256, 256)) for _ in range(3))
    # at most 256 * 256 rows
    for r in sums.collect():
        a[r["last"], r["node"]], b[r["last"], r["node"]], below[r["last"], r["node"]] = r["a"], r["b"], r["mixed"] / STEP
    own = log_kt(a, b)
    w1 = np.exp(own - np.logaddexp(own, below))
    mixed = np.logaddexp(own, below) - np.log(2)
    a0, b0, below0 = a.sum(axis=0), b.sum(axis=0), mixed.sum(axis=0)
    own0 = log_kt(a0, b0)
    return w1, (b + 0.5) / (a + b + 1), np.exp(own0 - np.logaddexp(own0, below0)), (b0 + 0.5) / (a0 + b0 + 1)


def values(model: DataFrame, near: tuple[np.ndarray, ...]) -> DataFrame:
    """kind, grp, slot, keys, answers: for each group's keys the log10 probability (runs) or training count (tokens)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (kind, grp, keys, counts) in enumerate(zip(*(batch[c].to_pylist() for c in ("kind", "grp", "keys", "counts")), strict=True)):
                if kind == RUNS:
                    every, own, n = _learned(keys, counts, np.uint32)
                    found = np.concatenate([np.zeros(0), *(nodes.predict(every[at : at + ONCE], near, grp >> 8) for nodes in (Nodes(own, n),) for at in range(0, len(every), ONCE))]).astype(np.float32)
                else:
                    found = _unpack(counts, np.int64).astype(np.float64)
                own = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([own["kind"], own["grp"], own["slot"], own["keys"], pa.array([_pack(found)], pa.binary())], names=["kind", "grp", "slot", "keys", "answers"])

    # small in bytes but not in work: more tasks than the table has files
    tasks = 4 * model.sparkSession.sparkContext.defaultParallelism
    return model.repartition(tasks, "kind", "grp").mapInArrow(work, "kind int, grp int, slot bigint, keys binary, answers binary")


def answered(levels: list[DataFrame], near: tuple[np.ndarray, ...], splits: int) -> DataFrame:
    """split, kind, grp, keys, answers of every split, handed down level by level."""

    def work(key: tuple, ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(ask):
            return pd.DataFrame({"id": [], "kind": [], "grp": [], "keys": [], "answers": []})
        kind, numbers = (np.uint32, np.float32) if key[0] == RUNS else (np.uint64, np.float64)
        known, found = _unpack(own["keys"].iloc[0], kind), _unpack(own["answers"].iloc[0], numbers)
        return pd.DataFrame({"id": ask["id"], "kind": key[0], "grp": key[1], "keys": ask["keys"], "answers": [_pack(found[np.searchsorted(known, _unpack(k, kind))]) for k in ask["keys"]]})

    above, on = values(levels[-1], near), ["kind", "grp", "slot"]
    for left, below in zip(reversed(sizes(splits)), reversed(levels[:-1]), strict=True):
        own = F.col("split") if "split" in below.columns else F.col("slot")
        asked = below.select(own.alias("id"), "kind", "grp", "keys", F.pmod("slot", F.lit(left)).alias("slot"))
        above = asked.groupBy(*on).cogroup(above.groupBy(*on)).applyInPandas(work, "id bigint, kind int, grp int, keys binary, answers binary").withColumnRenamed("id", "slot")
    return above.withColumnRenamed("slot", "split")


def scored(docs: DataFrame, answers: DataFrame, id_type: T.DataType, splits: int, floor: float) -> DataFrame:
    """Each split's answers, then its texts as a stream: n_tokens, n_known, base_score and score of every text."""
    none = F.lit(None)
    left = answers.select("split", F.lit(0).alias("part"), "kind", "grp", "keys", "answers", none.cast(id_type).alias("doc_id"), none.cast("boolean").alias("train"), none.cast("string").alias("text"))
    right = docs.select("split", F.lit(1).alias("part"), none.cast("int").alias("kind"), none.cast("int").alias("grp"), none.cast("binary").alias("keys"), none.cast("binary").alias("answers"), "doc_id", "train", "text")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("train", T.BooleanType())] + [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])

    def lookup(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
        if not (known[0][at] == keys).all():
            raise RuntimeError("the input's splits changed between two scans")
        return known[1][at]

    def ready(held: list) -> tuple[tuple, tuple]:
        out = []
        for kind in (RUNS, TOKENS):
            # a split that two scan tasks shared has two arrays a group
            some = sorted((g, k, v) for d, g, k, v in held if d == kind)
            keys = [_unpack(k, np.uint32).astype(np.uint64) | U(g << 32) if kind == RUNS else _unpack(k, np.uint64) for g, k, _ in some]
            values = [_unpack(v, np.float32 if kind == RUNS else np.float64) for _, _, v in some]
            keys, values = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(keys, kind="stable")
            out.append((keys[order], values[order]))
        return tuple(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for batch in batches:
            split, part = batch["split"].to_numpy(), batch["part"].to_numpy()
            turns = np.flatnonzero((np.diff(split) != 0) | (np.diff(part) != 0)) + 1
            edges = [0, *turns.tolist(), len(split)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                if split[first] != now:
                    now, held, known = split[first], [], None
                own = batch.slice(first, last - first)
                if part[first] == 0:
                    held += zip(*(own[c].to_pylist() for c in ("kind", "grp", "keys", "answers")), strict=True)
                    continue
                if known is None:
                    known, held = ready(held), []
                for lo, hi, words in slices(own["text"]):
                    keys, bounds = runs(words)
                    hashes, doc = tokens(words), words.doc
                    score = np.empty(hi - lo)
                    for k in range(hi - lo):
                        score[k] = lookup(known[0], np.sort(keys[bounds[k] : bounds[k + 1]])).sum(dtype=np.float64)
                    order = np.argsort(hashes)
                    c = np.empty(len(hashes))
                    c[order] = lookup(known[1], hashes[order])
                    end = lookup(known[1], np.array([END_TOKEN]))[0]
                    base = np.bincount(doc, np.log10(c + 1), minlength=hi - lo) + np.log10(end + 1) - (words.count + 1) * floor
                    seen = np.bincount(doc, c > 0, minlength=hi - lo).astype(np.int64) + int(end > 0)
                    yield pa.RecordBatch.from_arrays([own["doc_id"].slice(lo, hi - lo), own["train"].slice(lo, hi - lo), pa.array(words.count.astype(np.int64) + 1), pa.array(seen), pa.array(base), pa.array(score)], names=schema.names)

    # twice as many partitions as splits, so that few share one
    return left.unionByName(right).repartition(min(2 * splits, TASKS), "split").sortWithinPartitions("split", "part").mapInArrow(work, schema)


def in_splits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, train, text and split: a number for a fixed range of rows of a file, of about SPLIT bytes of text.

    The range depends on the file alone, not on how it is read, so it stays when executors come and go. A table that does not
    come from Parquet files is written first.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    rows = max(16, min(1 << 16, 1 << (max(SPLIT * size["n"] // max(size["bytes"] or 0, 1), 1).bit_length() - 1)))
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    own = [F.col(id_col).alias("doc_id"), (~held_out).alias("train"), F.col(text_col).cast("string").alias("text")]
    of_file = F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {rows}")).alias("split")
    try:
        return docs.select(*own, of_file)
    except AnalysisException:
        return written(docs.select(id_col, text_col)).select(*own, of_file)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10).

    Documents whose crc32(id as text) mod 7 is not 2 train the model; a null id trains too. Null and empty texts consist of
    their end. Without training texts every byte has probability 1/256. Repeated rows count as often as they occur.
    """
    base = in_splits(docs, id_col, text_col)
    parts = written(packed_counts(base))
    splits = max(1, parts.select("split").distinct().count())
    levels = merged(parts, splits)
    total = levels[-1].filter(f"kind = {TOKENS}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_unpack(c, np.int64) for c in batch["counts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], names=["n", "v"])

    size = total.select("counts").mapInArrow(sums, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = size["n"] or 0, size["v"] or 0
    answers = answered(levels, near_contexts(levels[-1]), splits)
    out = scored(base, answers, docs.schema[id_col].dataType, splits, float(np.log10(n + v + 1)))
    return out.withColumn("train_tokens", F.lit(n).cast("bigint"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
