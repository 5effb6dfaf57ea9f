"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over permuted blocks.

Each source is dealt by hash into blocks, which a permutation orders. A source takes whole passes over its blocks and a quota of
further blocks. The tree splits both among output shards: at each node the left half's blocks, a vector over the sources, are a multivariate
hypergeometric draw from the node's, and of each source's quota it gets what a hypergeometric draw of its blocks gives, so
no shard's quota exceeds its blocks and both stay exact at every level. A shard's blocks are a run of the permuted order, disjoint from the
others', of which it draws its quota; documents are ordered by hash within it. Blocks differ in words, so
quotas meet a target only nearly: blocks are added or taken away in the tree's order until the target falls into a block, which
is drawn by document, and one document may fill what is left.

Leaves are drawn where they are needed, from seeds that name the node; only source totals (a row a source) reach the driver.
Every choice is a hash of rows or a seed, so reruns and recomputed tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.tables import table, written

#: Blocks of a source: BLOCKS, and more beyond BLOCK_ROWS times as many rows.
BLOCKS = 1024
BLOCK_ROWS = 4096
#: Blocks of all sources together; the generator of the draws takes no more than 10**9.
MOST_BLOCKS = 1 << 28
#: Shards: one for SHARD_WORDS words of the mix, SHARDS at least.
SHARDS, SHARD_WORDS = 64, 5_000_000
#: The most partitions that shards are written to.
PARTITIONS = 1 << 17
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words that each source should give: share of all words by weight, at most `most` times a source's words."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return out


def leaf_quotas(first: int, last: int, shards: int, blocks: np.ndarray, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, pool, quota) of the leaves first to last - 1 of a tree over `shards`, each an array of a row a leaf and a column a source.

    blocks and quotas are the sources' own; a leaf's blocks are those from start to start + pool in permuted order.
    """
    start, pool, quota = (np.zeros((last - first, len(blocks)), dtype=np.int64) for _ in range(3))
    todo = [(0, shards, np.zeros(len(blocks), dtype=np.int64), blocks.astype(np.int64), quotas.astype(np.int64))]
    while todo:
        lo, hi, at, have, want = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            start[lo - first], pool[lo - first], quota[lo - first] = at, have, want
            continue
        mid = (lo + hi) // 2
        take = (int(have.sum()) * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, lo, hi])))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        some = rng.hypergeometric(left, have - left, want)
        todo += [(lo, mid, at, left, some), (mid, hi, at + left, have - left, want - some)]
    return start, pool, quota


def leaves(spark: SparkSession, shards: int, blocks: np.ndarray, quotas: np.ndarray, seed: int) -> DataFrame:
    """number (of the source), shard, start, pool, quota: the tree's leaves, drawn in ranges of shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            if not len(ids):
                continue
            found = leaf_quotas(int(ids[0]), int(ids[-1]) + 1, shards, blocks, quotas, seed)
            number = np.tile(np.arange(len(blocks), dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.repeat(ids, len(blocks))), *(pa.array(x.ravel()) for x in found)], names=["number", "shard", "start", "pool", "quota"])

    return spark.range(0, shards, 1, 1 + shards // 4096).mapInArrow(work, "number int, shard bigint, start bigint, pool bigint, quota bigint")


class Plan:
    """How often each document is drawn: a table of blocks and the columns that lead a document to its block's row."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, shard_words: int, seed: int, weights: tuple[float, ...]):
        spark = docs.sparkSession
        self.columns, self.seed = (id_col, text_col, source_col), seed
        rows = docs.select(*self._own(docs))
        self.sized = sized = written(rows)
        found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).orderBy(F.col("source").asc_nulls_last()).collect()
        self.count = count = max(1, min(max(BLOCKS, 1 << (sum(r["rows"] for r in found) // BLOCK_ROWS).bit_length()), 1 << ((MOST_BLOCKS // max(len(found), 1)).bit_length() - 1)))
        sizes = [r["words"] for r in found]
        goals = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
        passes = [int(min(g // s, 2)) if s else 0 for g, s in zip(goals, sizes, strict=True)]
        rests = [g - p * s for g, p, s in zip(goals, passes, sizes, strict=True)]
        quotas = np.array([min(count, round(count * r / s)) if s and r > 0 else 0 for r, s in zip(rests, sizes, strict=True)], dtype=np.int64)
        self.shards = max(SHARDS, round(sum(goals) / shard_words))
        odd = np.random.Generator(np.random.PCG64(seed)).integers(0, count, (len(found), 2)) | 1
        sources = spark.createDataFrame(
            [(k, r["source"], s, g, p, rest, int(a), int(c)) for k, (r, s, g, p, rest, (a, c)) in enumerate(zip(found, sizes, goals, passes, rests, odd, strict=True))],
            "number int, of_source string, source_size bigint, target double, passes int, rest double, turn bigint, move bigint",
        )
        blocks = sized.groupBy("source", self._block().alias("block")).agg(F.sum("size").alias("words"))
        blocks = blocks.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        mixed_up = f"pmod(block * turn + move, {count}L)"
        blocks = blocks.withColumn("place", F.expr(f"{mixed_up} ^ shiftright({mixed_up}, {max(count.bit_length() // 2, 1)})"))
        drawn = leaves(spark, self.shards, np.full(len(found), count), quotas, seed).filter("pool > 0")
        drawn = drawn.select("number", "shard", F.explode(F.expr("sequence(start, start + pool - 1)")).alias("place"), (F.col("start") + F.col("quota")).alias("until"))
        dealt = written(blocks.join(drawn, ["number", "place"]).withColumn("own", F.col("place") < F.col("until")).drop("until"))
        # drawn blocks come first, shard by shard, then the others; the target ends somewhere on that way
        runs = dealt.groupBy("number", "own", "shard").agg(F.sum("words").alias("held"))
        way = Window.partitionBy("number").orderBy(F.col("own").desc(), "shard").rowsBetween(Window.unboundedPreceding, 0)
        runs = runs.withColumn("ahead", F.sum("held").over(way) - F.col("held")).drop("held")
        within = Window.partitionBy("number", "own", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        dealt = dealt.join(runs, ["number", "own", "shard"]).withColumn("before", F.col("ahead") + F.sum("words").over(within) - F.col("words"))
        part = F.expr("CASE WHEN rest <= 0 OR before >= rest THEN 0 WHEN before + words <= rest THEN 2 ELSE 1 END")
        dealt = written(dealt.withColumn("part", part).drop("own", "ahead", "place", "turn", "move"))
        self.blocks = written(self._singles(dealt))

    def _own(self, docs: DataFrame) -> list[Column]:
        """size, source and at of a row; at, a hash of id, source and text, is the same for equal rows."""
        id_col, text_col, source_col = self.columns
        text, source = F.coalesce(docs[text_col].cast("string"), F.lit("")), docs[source_col].cast("string")
        size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
        return [docs[id_col].alias("doc_id"), source.alias("source"), size.alias("size"), F.xxhash64(F.lit(self.seed), docs[id_col], source, text).alias("at")]

    def _block(self) -> Column:
        return F.pmod(F.shiftright("at", 20), F.lit(self.count))

    def _joined(self, rows: DataFrame, blocks: DataFrame) -> DataFrame:
        blocks = blocks.withColumnRenamed("source", "of_source").withColumnRenamed("block", "of_block")
        return rows.withColumn("mx_block", self._block()).join(blocks, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("mx_block") == F.col("of_block"))).drop("of_source", "of_block", "mx_block")

    def _singles(self, dealt: DataFrame) -> DataFrame:
        """The blocks with `some`: hashes of single documents that are drawn once more, of the block in which a target ends, and of a source's last one."""
        narrow = dealt.select("source", "block", "number", "rest", "before", "part")
        rows = self._joined(self.sized, narrow)
        # equal rows are peers in this order: they fit together or not at all
        edge = rows.filter("part = 1").withColumn("fits", F.col("before") + F.sum("size").over(Window.partitionBy("number").orderBy("at")) <= F.col("rest"))
        edge = written(edge.select("number", "at", "size", "fits"))
        inside = edge.filter("fits").groupBy("number").agg(F.collect_set("at").alias("fitting"), F.sum("size").alias("gone"))
        whole = dealt.filter("part = 2").groupBy("number").agg(F.sum("words").alias("whole"))
        short = dealt.groupBy("number").agg(F.max("rest").alias("rest")).join(whole, "number", "left").join(inside, "number", "left")
        short = written(short.select("number", "fitting", (F.col("rest") - F.coalesce("whole", F.lit(0)) - F.coalesce("gone", F.lit(0))).alias("short")).filter("short > 0 OR fitting IS NOT NULL"))
        idle = rows.filter("part = 0 AND rest > 0").select("number", "at", "size").unionByName(edge.filter("NOT fits").select("number", "at", "size"))
        able = idle.join(short.select("number", "short"), "number").filter("size > 0 AND abs(size - short) < short")
        last = written(able.groupBy("number").agg(F.min_by("at", F.struct(F.abs(F.col("size") - F.col("short")), "at")).alias("last")))
        # of a row that repeats, all copies are drawn: only where they are nearer together than none
        copies = able.join(last, "number").filter("at = last").groupBy("number", "last").agg(F.sum("size").alias("held"), F.max("short").alias("short"))
        last = copies.filter("abs(held - short) < short").select("number", "last")
        marks = short.select("number", "fitting").join(last, "number", "left")
        none = F.expr("cast(array() as array<bigint>)")
        in_block = F.pmod(F.shiftright("last", 20), F.lit(self.count)) == F.col("block")
        some = F.concat(F.when(F.col("part") == 1, F.coalesce("fitting", none)).otherwise(none), F.when(in_block, F.array("last")).otherwise(none))
        return dealt.join(marks, "number", "left").select("source", "block", "source_size", "target", "passes", (F.col("part") == 2).alias("whole"), F.coalesce(some, none).alias("some"), "shard")

    def draws(self, rows: DataFrame) -> DataFrame:
        """rows (source and at among their columns) with source_size, target and draws: an array of copy and shard, an entry a time a row is drawn."""
        out = self._joined(rows, self.blocks)
        times = F.col("passes") + (F.col("whole") | F.array_contains("some", F.col("at"))).cast("int")
        entry = lambda c: F.struct(c.alias("copy"), F.pmod(F.col("shard") + c * F.lit(self.shards // 2), F.lit(self.shards)).alias("shard"))
        draws = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda c: c < times), entry)
        return out.withColumn("draws", draws).drop("passes", "whole", "some", "shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, draws (array of copy and shard; one entry a time it is taken).

    Sources by code point, null last, get `weights` in turn. Null text has size 0. Documents without words are drawn with
    their block. Rows that repeat an id are documents of their own; rows that also repeat source and text share their draws. An
    empty table gives no rows.
    """
    plan = Plan(docs, id_col, text_col, source_col, shard_words, seed, weights)
    return plan.draws(plan.sized).select("doc_id", "size", "source_size", "target", "draws", "at")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS, seed: int = 7, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document's columns as often as it is drawn, a shard a partition (or several, beyond PARTITIONS shards), shuffled within shards.

    Rows are drawn one by one, as in mix(): where an id repeats with other texts, each row has draws of its own.
    """
    plan = Plan(docs, id_col, text_col, source_col, shard_words, seed, weights)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("mx_doc"), *plan._own(docs))
    out = plan.draws(packed).select("mx_doc", "at", F.explode("draws").alias("draw"))
    out = out.select("mx_doc", F.col("draw.shard").alias("shard"), F.xxhash64("at", "draw.copy").alias("turn"))
    # by number, not by hash, so that no partition holds several shards while others have none
    parts = min(plan.shards, PARTITIONS)
    return out.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "turn").select("mx_doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("bigint").alias("taken"))
