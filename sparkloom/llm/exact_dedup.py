"""Exact dedup by progressive refinement: length, then prefix hash, then full digest, each only within surviving groups.

Only built-in functions run. A first scan writes a narrow row a document: the length and the first characters of its normalised text.
Level one counts lengths; prefixes are hashed only of rows whose length is shared, and the second scan digests only texts
whose length and prefix hash are shared. Texts are never exchanged: what survives a level is a bitmap of bounded size.
Copies are counted and their keeper found with partial aggregates, so a group with a third of all rows costs a row a task;
the join that hands results back is a plain sort-merge join, which adaptive execution splits by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.tables import bitmap, marked, maybe_in, table, written

#: Characters that equality ignores.
BLANKS = r"[\x20\x09-\x0D]"
PREFIX = 64


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, points (code points of the text), norm and its length in bytes."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"))
    base = base.select("doc_id", F.char_length("raw").alias("points"), normal(F.col("raw")).alias("norm"))
    return base.withColumn("len", F.octet_length("norm").cast("bigint"))


def same_length(narrow: DataFrame) -> DataFrame:
    """Level one: the rows of narrow (len, prefix) whose length some other row may share; none that does is missing."""
    shared = written(narrow.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1"))
    return maybe_in(narrow, F.col("len"), bitmap(shared, "len", shared.count()))


def same_prefix(survivors: DataFrame) -> DataFrame:
    """Level two, on survivors of level one: key and n of the (length, prefix hash) pairs that several rows share."""
    pairs = survivors.select("len", F.xxhash64("prefix").alias("head")).groupBy("len", "head").agg(F.count("*").alias("n"))
    return pairs.filter("n > 1").select(F.xxhash64("len", "head").alias("key"), "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after white space goes. The row with the most code points in its original text stays, then
    the smallest id. Null text is empty text. Rows that repeat an id and text all count in group_size and share `kept`;
    a null id loses every tie. text_sha256 is null for texts that levels one and two prove unique, unless `digest_all`.
    """
    base = normalised(docs, id_col, text_col)
    narrow = written(base.select("len", F.substring("norm", 1, PREFIX).alias("prefix")))
    pairs = written(same_prefix(same_length(narrow)))
    key = F.xxhash64("len", F.xxhash64(F.substring("norm", 1, PREFIX)))
    probed = marked(base, key, bitmap(pairs, "key", pairs.count())).withColumnRenamed("bm_maybe", "open")
    digest = F.sha2("norm", 256)
    flat = written(probed.select("doc_id", "points", "open", (digest if digest_all else F.when(F.col("open"), digest)).alias("text_sha256")))
    # a document that no level joins to another is its own group and needs no exchange
    alone = flat.filter(~F.col("open")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    open_rows = flat.filter("open")
    groups = written(
        open_rows.groupBy("text_sha256").agg(
            F.count("*").alias("group_size"),
            F.max_by("doc_id", F.struct("points", -F.col("doc_id"))).alias("keep_id"),
        )
    )
    shared = open_rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(shared)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns as they came. Of rows that repeat an id and text one stays."""
    gone = exact_dedup(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("dd_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["dd_gone"], "left_anti").dropDuplicates([id_col, text_col])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, length(raw) AS points, sha256(norm) AS text_sha256 FROM n),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY points DESC, doc_id) AS keep_id FROM h GROUP BY 1)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256 FROM h JOIN g USING (text_sha256)
"""
