"""Exact top-k of binary codes by incremental multi-index hashing.

Codes are dealt into blocks, large enough that an index answers with far fewer probes than a scan has codes. In a block, every
segment of the codes has a table from segment value to rows. The radius of segment search grows until the k-th verified
Hamming distance can't be beaten by any code that no segment has met yet, so a block's answer is provably exact, and so is the
merge of the blocks' best k. Each query first searches the block that its own code belongs to; the k-th distance found there
bounds the search of all others. Of rows with equal codes only the k + 1 least ids can be among anyone's k, so no more are indexed.
Queries are a stated set; they are dealt into slices, and a task searches one block for one slice.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.tables import table, written

BITS, SEGMENTS, K = 64, 4, 10
#: Codes of a block, queries of a slice, and the most partitions that pairs of them are dealt to.
BLOCK, SLICE, TASKS = 1 << 18, 2048, 1 << 16
WIDTH = BITS // SEGMENTS


def masks(radius: int) -> np.ndarray:
    """All segment values with `radius` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], dtype=np.int64)


class Index:
    def __init__(self, codes: np.ndarray):
        self.codes, self.met, self.verified = codes, np.zeros(len(codes), dtype=bool), 0
        self.order, self.starts = [], []
        for s in range(SEGMENTS):
            value = self.segment(codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))]))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, query: np.uint64, own: int, k: int, bound: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes, but row `own`, within the k-th distance and `bound` (ties stay); all within it if there are no k others."""
        if own >= 0:
            self.met[own] = True
        rows, distances = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        values = [int(self.segment(np.array([query]), s)[0]) for s in range(SEGMENTS)]
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                probe = values[s] ^ masks_of(radius)
                lo, hi = self.starts[s][probe], self.starts[s][probe + 1]
                some = hi > lo
                lo, size = lo[some], (hi - lo)[some]
                if not len(size):
                    continue
                at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
                found = self.order[s][at]
                found = found[~self.met[found]]
                self.met[found] = True
                rows.append(found)
                distances.append(np.bitwise_count(self.codes[found] ^ query).astype(np.int64))
            rows, distances = [np.concatenate(rows)], [np.concatenate(distances)]
            # a code that no segment has met differs by more than radius in each
            limit = min(bound, np.partition(distances[0], k - 1)[k - 1]) if len(rows[0]) >= k else bound
            if limit < SEGMENTS * (radius + 1):
                break
        self.met[rows[0]] = False
        if own >= 0:
            self.met[own] = False
        self.verified = len(rows[0])
        keep = distances[0] <= limit
        return rows[0][keep], distances[0][keep]


_MASKS: dict[int, np.ndarray] = {}


def masks_of(radius: int) -> np.ndarray:
    if radius not in _MASKS:
        _MASKS[radius] = masks(radius)
    return _MASKS[radius]


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and a 64-bit code: bit i is set where value i is 0 or more. Missing values and null vectors have no bits set."""
    bits = " + ".join(f"CASE WHEN coalesce(get({vector_col}, {i}) >= 0, false) THEN {1 << i if i < 63 else -(1 << 63)}L ELSE 0L END" for i in range(63))
    top = f"CASE WHEN coalesce(get({vector_col}, 63) >= 0, false) THEN -9223372036854775807L - 1L ELSE 0L END"
    return vectors.select(F.col(id_col).alias("vec_id"), F.expr(f"({bits}) | ({top})").alias("code"))


FOUND = "query_id bigint, vec_id bigint, distance bigint"


def searched(dealt: DataFrame, asked: DataFrame, blocks: int, slices: int, k: int) -> DataFrame:
    """query_id, vec_id, distance: each asked query's best k, within its bound, of the block that it is asked of.

    dealt holds vec_id, code, block; asked holds query_id, code, block, bound.
    """
    slice_ = F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(slices))
    asked = asked.withColumn("slice", slice_)
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))

    def work(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype("int64")]
        if len(own) and len(ask):
            ids, values = own["vec_id"].to_numpy(), own["code"].to_numpy().view(np.uint64)
            order = np.argsort(ids)
            ids, values = ids[order], values[order]
            index = Index(values)
            for query, code, bound in zip(ask["query_id"], ask["code"].to_numpy().view(np.uint64), ask["bound"], strict=True):
                at = int(np.searchsorted(ids, query))
                rows, distances = index.search(code, at if at < len(ids) and ids[at] == query else -1, k, int(bound))
                best = np.lexsort((ids[rows], distances))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[rows[best]], "distance": distances[best]}))
        return pd.concat(out)

    # pairs of block and slice are small in bytes but not in work: a partition each, which adaptive execution leaves apart
    tasks, on = min(blocks * slices, TASKS), ["block", "slice"]
    return dealt.repartition(tasks, *on).groupBy(*on).cogroup(asked.repartition(tasks, *on).groupBy(*on)).applyInPandas(work, FOUND)


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest other codes of each query, ties by id.

    codes and queries have vec_id and code. A row never answers itself; of rows that repeat an id the least code counts. Fewer than
    k others give fewer rows. Null ids and codes are left out.
    """
    own = codes.filter("vec_id IS NOT NULL AND code IS NOT NULL").groupBy("vec_id").agg(F.min("code").alias("code"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    codes = written(own.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place"))
    asked = written(queries.filter("vec_id IS NOT NULL AND code IS NOT NULL").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("code").alias("code")))
    blocks, count = max(1, -(-codes.count() // BLOCK)), asked.count()
    home = F.pmod(F.xxhash64("code"), F.lit(blocks))
    dealt = codes.withColumn("block", home)
    first = searched(dealt, asked.withColumn("block", home).withColumn("bound", F.lit(BITS)), blocks, max(1, -(-count // blocks // SLICE)), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    if blocks > 1:
        first = written(first)
        bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        bound = F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(BITS)).cast("int")
        others = asked.join(bounds, "query_id", "left").withColumn("home", home).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        others = others.filter("block <> home").select("query_id", "code", "block", F.coalesce(bound, F.lit(BITS)).alias("bound"))
        first = first.unionByName(searched(dealt, others, blocks, max(1, -(-count // SLICE)), k))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.filter("vec_id % 50 = 0")).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "distance")


SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS bits FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id, len(list_filter(list_zip(q.bits, c.bits), lambda z: z[1] <> z[2]))::BIGINT AS distance
      FROM c q JOIN c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d
QUALIFY rank <= 10
"""
