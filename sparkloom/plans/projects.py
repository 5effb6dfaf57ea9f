"""Several source trees, each scanned, parsed, linked and indexed into a store of its own."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import chunks, deps, index
from sparkloom.operators.parse import parse_files
from sparkloom.plans.pipeline import Tools
from sparkloom.sources import scan, scratch, store
from sparkloom.sources import views as V

TABLES = ("files", "lines", "symbols", "deps", "postings", "lengths", "vectors")


class Projects:
    """Projects by root. index() writes a whole new version of a project's tables and only then points to it: readers see the old or the new one."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{scratch.folder(spark)}/projects"

    def _root(self, root: str) -> str:
        return f"{self.folder}/{hashlib.sha256(root.rstrip('/').encode()).hexdigest()[:16]}"

    def index(self, root: str, options: scan.ScanOptions | None = None, ignore_text: str = "") -> dict:
        """Scans the tree anew; root, files, chunks and symbols of the new version."""
        files = scratch.written(scan.read_tree(self.spark, root, options, ignore_text))
        parsed = scratch.written(parse_files(files))
        own = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.line_start", "s.line_end")
        symbols = scratch.written(chunks.clip_ranges(own))
        named = parsed.select("path", "namespace", "imports")
        terms = index.term_tables(files, "path", F.col("content"))
        tables = {"files": files.join(named, "path"), "lines": V.lines(files), "symbols": symbols, "deps": deps.resolve(files, parsed), **terms, "vectors": index.hashed_vectors(files, "path", F.col("content"))}
        seq = 1 + self._seq(root)
        store.save(self.spark, self._root(root), tables, root.rstrip("/"), seq)
        count = chunks.chunk_files(files, symbols).count()
        return {"root": root.rstrip("/"), "files": files.count(), "chunks": count, "symbols": symbols.count(), "seq": seq}

    def _seq(self, root: str) -> int:
        held = store.load(self.spark, self._root(root), root.rstrip("/"), "files")
        return store.manifest(self.spark, self._root(root)).first()["seq"] if held else 0

    def projects(self) -> DataFrame:
        """root, seq and tables of every project that was indexed."""
        try:
            stamps = self.spark.read.parquet(f"{self.folder}/*/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], "root string, seq bigint, tables array<string>")
            raise
        return stamps.groupBy(F.col("config").alias("root")).agg(F.max("seq").alias("seq"), F.max_by("tables", "seq").alias("tables")).orderBy("root")

    def tools(self, root: str) -> Tools:
        """The tools over a project's current tables; an unknown root is an error."""
        held = store.load(self.spark, self._root(root), root.rstrip("/"), *TABLES)
        if held is None:
            raise ValueError(f"not indexed: {root}")

        def embed(query: str) -> list[float]:
            one = self.spark.createDataFrame([(0, query)], "id int, text string")
            row = index.hashed_vectors(one, "id", F.col("text")).first()
            return list(row["embedding"]) if row else [0.0] * 64

        return Tools(held["files"], held["lines"], held["symbols"], held["deps"], {k: held[k] for k in ("postings", "lengths", "vectors")}, embed)
