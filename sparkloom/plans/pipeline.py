"""Chains of find, search, filter, limit and outline steps over a set of paths, and named tools with lenient arguments."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.globs import glob_to_regex
from sparkloom.operators import communities, lookups, modules, search
from sparkloom.operators import graph as G


def run(files: DataFrame, lines: DataFrame, symbols: DataFrame, steps: list[dict]) -> DataFrame:
    """The last step's rows: paths, or the outline rows of at most 20 files. limit counts in path order: ranks don't survive."""
    paths = files.select("path")
    for step in steps:
        op = step.get("op")
        if op == "find":
            held = files.join(paths, "path", "left_semi")
            paths = lookups.find(held, str(step.get("query", "")), step.get("limit", 50)).select("path")
        elif op == "search":
            held = lines.join(paths, "path", "left_semi")
            paths = lookups.grep(held, str(step.get("query", "")), bool(step.get("regex"))).select("path").distinct()
        elif op == "filter":
            if step.get("glob"):
                paths = paths.filter(F.col("path").rlike(glob_to_regex(step["glob"])))
            if step.get("language"):
                paths = paths.join(files.filter(F.col("language") == step["language"]).select("path"), "path", "left_semi")
        elif op == "limit":
            paths = paths.orderBy("path").limit(lookups.clamp(step.get("n"), 10, 1, 10_000))
        elif op == "outline":
            few = paths.orderBy("path").limit(20)
            return symbols.join(few, "path", "left_semi").select("path", "name", "line_start", "line_end").orderBy("path", "line_start")
        else:
            raise ValueError(f"unknown step {op!r}")
    return paths.orderBy("path")


#: Rows that a call answers with at most; frame() gives all of them as a table.
MOST_ROWS = 10_000


class Tools:
    """Named read-only tools over one corpus of tables: path and content, lines, symbols and dependencies.

    index, if there is one, holds postings and lengths by path, and may hold vectors (path, embedding) with `embed`, which turns a query
    into a vector: then search is hybrid, but for regexes, globs and compact output, which read lines.
    """

    def __init__(self, files: DataFrame, lines: DataFrame, symbols: DataFrame, deps: DataFrame, index: dict[str, DataFrame] | None = None, embed: Callable[[str], list[float]] | None = None):
        self.files, self.lines, self.symbols, self.deps, self.index, self.embed = files, lines, symbols, deps, index, embed
        self.known: dict[str, tuple[Callable[[dict], DataFrame], dict[str, str]]] = {
            "tree": (lambda a: lookups.tree(files, symbols), {}),
            "ls": (lambda a: lookups.ls(files, text(a, "path")), {"path": "string"}),
            "glob": (lambda a: lookups.glob(files, text(a, "pattern", True), number(a, "max_results")), {"pattern": "string", "max_results": "integer"}),
            "find": (lambda a: lookups.find(files, text(a, "query", True), number(a, "max_results")), {"query": "string", "max_results": "integer"}),
            "outline": (lambda a: lookups.outline(symbols, text(a, "path", True)), {"path": "string"}),
            "symbol": (lambda a: lookups.symbols_named(symbols, text(a, "name", True), lines if a.get("body") is True else None), {"name": "string", "body": "boolean"}),
            "read": (self._read, {"path": "string", "line_start": "integer", "line_end": "integer", "compact": "boolean", "if_hash": "string"}),
            "search": (self._search, {"query": "string", "regex": "boolean", "path_glob": "string", "compact": "boolean", "max_results": "integer"}),
            "communities": (self._communities, {"community": "string", "limit": "integer"}),
            "deps": (self._deps, {"path": "string", "direction": "string", "transitive": "boolean", "max_depth": "integer"}),
            "status": (lambda a: lookups.status(files), {}),
            "query": (lambda a: run(files, lines, symbols, a.get("pipeline") or []), {"pipeline": "array"}),
            "module_map": (lambda a: modules.module_map(files, deps, symbols, number(a, "limit") or 40, number(a, "min_files") or 2, text(a, "path_prefix")), {"limit": "integer", "min_files": "integer", "path_prefix": "string"}),
        }

    def _deps(self, a: dict) -> DataFrame:
        deps = self.deps if a.get("direction") == "depends_on" else G.reverse(self.deps)
        path = text(a, "path", True)
        if a.get("transitive") is not True:
            return deps.filter(F.col("src") == path).select(F.col("dst").alias("path")).distinct().orderBy("path")
        start = self.files.sparkSession.createDataFrame([(path,)], "node string")
        return G.reachable(deps, start, number(a, "max_depth")).select(F.col("node").alias("path")).orderBy("path")

    def _search(self, a: dict) -> DataFrame:
        query, most = text(a, "query", True), number(a, "max_results") or 50
        if self.index is None or a.get("regex") is True or a.get("path_glob") or a.get("compact") is True:
            return lookups.grep(self.lines, query, a.get("regex") is True, a.get("path_glob"), a.get("compact") is True, most)
        paths = self.files.select(F.col("path").alias("unit"), "path")
        known = self.symbols.select(F.col("path").alias("unit"), "path", F.lower("name").alias("name"))
        vectors = self.index.get("vectors") if self.embed else None
        vector = F.array(*map(F.lit, self.embed(query))) if vectors is not None else None
        units = {k: x.withColumnRenamed("path", "unit") for k, x in self.index.items()}
        found = search.hybrid(units["postings"], units["lengths"], paths, units.get("vectors") if vectors is not None else None, query, vector, "unit", most, known)
        return found.select("rank", "path", "score").orderBy("rank")

    def _read(self, a: dict) -> DataFrame:
        """Numbered lines; one row `unchanged` if the file's hash is if_hash; paths like the wanted one if there is none."""
        path = text(a, "path", True)
        own = self.files.filter(F.col("path") == path)
        held = own.select(X.fingerprint(F.col("content")).alias("hash")).first()
        if held is None:
            return lookups.suggestions(self.files, path).withColumnRenamed("path", "did_you_mean")
        if held["hash"] == a.get("if_hash"):
            return own.select(F.lit(True).alias("unchanged"), X.fingerprint(F.col("content")).alias("hash"))
        return lookups.read_lines(self.lines, path, number(a, "line_start") or 1, number(a, "line_end"), a.get("compact") is True)

    def _communities(self, a: dict) -> DataFrame:
        """The largest communities of files, or the members of one of them."""
        nodes = self.files.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("file").alias("type"), F.col("path").alias("file_path"))
        edges = self.deps.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1.0).alias("weight"))
        found = communities.louvain(nodes.select("id"), edges).select("id", F.col("community").cast("string").alias("community"))
        if text(a, "community"):
            return G.community_members(found, nodes, edges, text(a, "community"), number(a, "limit") or 50)
        return G.community_overview(found, nodes, edges, number(a, "limit") or 40).orderBy("rank")

    def frame(self, name: str, args: dict | None = None) -> DataFrame:
        """A tool's rows as a table."""
        if name not in self.known:
            raise ValueError(f"unknown tool {name}")
        return self.known[name][0](args or {})

    def schemas(self) -> list[dict]:
        return [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in args.items()}}} for n, (_, args) in sorted(self.known.items())]

    def call(self, name: str, args: dict | None = None) -> list[dict] | str:
        """The tool's first MOST_ROWS rows; unknown tools, stubs and bad arguments answer with a text that starts with `error:`."""
        if name in ("edit", "remote"):
            return f"error: {name} isn't available: the corpus is read-only"
        if name == "bundle":
            ops = (args or {}).get("ops") or []
            if len(ops) > 100 or any(o.get("tool") == "bundle" for o in ops):
                return "error: at most 100 tools, none of them a bundle"
            return [{"tool": o.get("tool"), "result": self.call(o.get("tool", ""), o.get("arguments"))} for o in ops]
        try:
            return [json.loads(r) for r in self.frame(name, args).limit(MOST_ROWS).toJSON().collect()]
        except ValueError as e:
            return f"error: {e}"


def text(args: dict, name: str, needed: bool = False) -> str:
    value = args.get(name)
    if isinstance(value, str):
        return value
    if needed:
        raise ValueError(f"missing argument {name}")
    return ""


def number(args: dict, name: str) -> int | None:
    value = args.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else None
