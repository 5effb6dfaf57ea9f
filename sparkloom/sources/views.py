"""Corpus tables over the given tables: documents as files, foreign keys as a dependency graph, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.sources.scratch import parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content and doc_id of every document."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def lines(files_: DataFrame, *keep: str) -> DataFrame:
    """path, line (from 1), text and kept columns of every line."""
    return files_.select("path", *keep, F.posexplode(X.lines_of(F.col("content"))).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("bigint"))


def symbols(lines_: DataFrame) -> DataFrame:
    """A symbol for each line that begins with a capitalised identifier."""
    name = F.regexp_extract("text", "^[^A-Za-z_]*([A-Z][A-Za-z0-9_]*)", 1)
    return lines_.select("path", name.alias("name"), F.lit("symbol").alias("kind"), F.col("line").alias("line_start"), F.col("line").alias("line_end")).filter("name <> ''")


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: customers and suppliers depend on nations, nations on regions."""
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))

    def node(kind: str, key: str):
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    del region
    return (
        nation.select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst"))
        .unionByName(supplier.select(node("supplier", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst")))
        .unionByName(customer.select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst")))
    )


def key_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, type and file_path of the graph's nodes; the path is region / nation / own name."""
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "n_regionkey", "r_name")

    def node(kind: str, key: str, label: str, path: list[str], frame: DataFrame) -> DataFrame:
        return frame.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("type"), F.concat_ws("/", *path).alias("file_path"))

    return (
        node("region", "r_regionkey", "r_name", ["r_name"], region)
        .unionByName(node("nation", "n_nationkey", "n_name", ["r_name", "n_name"], places))
        .unionByName(node("supplier", "s_suppkey", "s_name", ["r_name", "n_name", "s_name"], supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))))
        .unionByName(node("customer", "c_custkey", "c_name", ["r_name", "n_name", "c_name"], customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))))
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (supplier), target (part), weight: order lines that tie them."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    # few pairs repeat: counted in even parts, not first in each file's
    pair = lines.repartition(parts(spark, lines.count()), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    return pair.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), "weight")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding", "label")
