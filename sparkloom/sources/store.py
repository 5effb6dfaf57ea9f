"""Index directories: named Parquet tables with a manifest that is written last, and a pointer to the current version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def config_hash(spark: SparkSession, options: dict) -> str:
    """A hash of scan options and model; storage and diagnostics settings don't enter it."""
    import hashlib
    import json

    kept = {k: v for k, v in options.items() if k not in ("storage_dir", "diagnostics", "use_storage")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], config: str, seq: int = 1) -> str:
    """Writes a new version beside the old ones and points to it last; readers see the old or the new one, never a part."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/v_{version}/{name}")
    stamp = spark.createDataFrame([(VERSION, version, config, seq, sorted(tables))], "format int, version string, config string, seq bigint, tables array<string>")
    stamp.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest").orderBy(F.desc("seq")).limit(1)


def load(spark: SparkSession, root: str, config: str, *names: str) -> dict[str, DataFrame] | None:
    """The current version's tables, all or the named ones; None if there is none of this format and configuration."""
    try:
        row = manifest(spark, root).filter((F.col("format") == VERSION) & (F.col("config") == config)).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if row is None:
        return None
    return {n: spark.read.parquet(f"{root}/v_{row['version']}/{n}") for n in (names or row["tables"])}


def unchanged(stored: DataFrame, current: DataFrame, *columns: str) -> bool:
    """Whether both listings hold the same (path, columns)."""
    a, b = (x.select("path", *columns) for x in (stored, current))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def upsert(stored: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    """stored with the rows of fresh in place of those of the same key."""
    return stored.join(fresh.select(*key).distinct(), list(key), "left_anti").unionByName(fresh)
