"""Listings and lookups: tree, folders, globs, fuzzy find, newest, words, lines, grep, outlines, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.globs import glob_to_regex


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def tree(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """path, language, line_count and symbol count, by path."""
    out = files.select("path", "language", F.size(X.lines_of(F.col("content"))).cast("bigint").alias("line_count"))
    if symbols is not None:
        out = out.join(symbols.groupBy("path").agg(F.count("*").alias("symbols")), "path", "left").fillna({"symbols": 0})
    return out.orderBy("path")


def ls(files: DataFrame, prefix: str = "") -> DataFrame:
    """entry, kind (dir or file) and files below it, for each child of a folder."""
    clean = prefix.strip("/")
    rest = F.substring("path", len(clean) + 2 if clean else 1, 1 << 30)
    inside = files.filter(F.col("path").startswith(f"{clean}/")) if clean else files
    head = F.split(rest, "/")
    kind = F.when(F.size(head) > 1, "dir").otherwise("file")
    return inside.select(head[0].alias("entry"), kind.alias("kind")).groupBy("entry", "kind").agg(F.count("*").alias("files")).orderBy("kind", "entry")


def glob(files: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """The first paths, by path, that a glob matches; a bad pattern matches nothing."""
    try:
        match = F.col("path").rlike(glob_to_regex(pattern))
    except ValueError:
        match = F.lit(False)
    return files.filter(match).select("path").orderBy("path").limit(clamp(limit, 200, 1, 5000))


def find(files: DataFrame, query: str, limit: int | None = None, digits: int = 6) -> DataFrame:
    """Fuzzy path search: path and score, best first."""
    scored = files.select("path", F.round(X.fuzzy_score(F.col("path"), query), digits).alias("score")).filter("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), "path").limit(clamp(limit, 10, 1, 50))


def suggestions(files: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Paths that a path which is not there may mean, best first."""
    return find(files, query, limit)


def hot(files: DataFrame, limit: int | None = None) -> DataFrame:
    return files.select("path", "modified_ms").orderBy(F.desc("modified_ms"), "path").limit(clamp(limit, 10, 1, 1000))


def read_lines(lines: DataFrame, path: str, first: int = 1, last: int | None = None, skip_comments: bool = False) -> DataFrame:
    """Numbered lines of one file; a path that leaves the root has none."""
    if ".." in path.split("/") or path.startswith("/"):
        return lines.filter(F.lit(False)).select("line", "text")
    out = lines.filter((F.col("path") == path) & (F.col("line") >= first))
    if last is not None:
        out = out.filter(F.col("line") <= last)
    if skip_comments:
        out = out.filter(~X.is_comment_or_blank(F.col("text")))
    return out.select("line", "text").orderBy("line")


def defines(content: Column, name: str) -> Column:
    """Whether a text seems to define the name: a type keyword before it, or a bracket behind it."""
    return F.reduce(F.array(*(F.contains(content, F.lit(x)) for x in [*(f"{kind} {name}" for kind in ("class", "interface", "struct", "enum", "record")), f" {name}("])), F.lit(False), lambda a, b: a | b)


def file_texts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path and the text that stands for a file in semantic search: path, stem and folder, namespace, imports, and its symbols by line.

    files holds path, namespace and imports; symbols path, name, kind and line_start.
    """
    named = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_start", "kind", "name"))).alias("s"))
    held = files.join(named, "path", "left")
    lines = F.concat(
        F.array(F.col("path"), F.concat_ws(" ", X.stem(F.col("path")), X.parent_name(F.col("path")))),
        F.when(F.col("namespace").isNotNull(), F.array(F.concat(F.lit("namespace "), F.col("namespace")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce("imports", F.array().cast("array<string>")), lambda i: F.concat(F.lit("import "), i)),
        F.coalesce(F.transform("s", lambda x: F.concat_ws(" ", x["kind"], x["name"])), F.array().cast("array<string>")),
    )
    return held.select("path", F.array_join(lines, "\n").alias("text"))


def grep(lines: DataFrame, query: str, regex: bool = False, pattern: str | None = None, skip_comments: bool = False, limit: int | None = None) -> DataFrame:
    """path, line, text of lines with a match, case ignored, by path and line."""
    hit = F.col("text").rlike(f"(?i){query}") if regex else F.contains(F.lower("text"), F.lit(query.lower()))
    out = lines.filter(hit)
    if pattern is not None:
        try:
            out = out.filter(F.col("path").rlike(glob_to_regex(pattern)))
        except ValueError:
            out = out.filter(F.lit(False))
    if skip_comments:
        out = out.filter(~X.is_comment_or_blank(F.col("text")))
    out = out.select("path", "line", "text")
    return out.orderBy("path", "line").limit(limit) if limit else out


def per_file(hits: DataFrame, cap: int = 5) -> DataFrame:
    """The first hits of each file, with how many it has."""
    by_line = Window.partitionBy("path").orderBy("line")
    counted = hits.withColumn("place", F.row_number().over(by_line)).withColumn("hits", F.count("*").over(Window.partitionBy("path")))
    return counted.filter(F.col("place") <= cap).drop("place")


def preview(lines: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first lines of each chunk that aren't comments or blank."""
    held = lines.join(chunks, "path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")) & ~X.is_comment_or_blank(F.col("text")))
    place = F.row_number().over(Window.partitionBy("path", "start_line").orderBy("line"))
    return held.withColumn("place", place).filter(F.col("place") <= n)


def outline(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.filter(F.col("path") == path).select("name", "kind", "line_start", "line_end").orderBy("line_start", "name")


def symbols_named(symbols: DataFrame, name: str, lines: DataFrame | None = None) -> DataFrame:
    """Symbols of exactly that name; with lines also their bodies."""
    out = symbols.filter(F.col("name") == name).select("path", "name", "kind", "line_start", "line_end")
    if lines is None:
        return out.orderBy("path", "line_start")
    body = out.join(lines.select("path", "line", "text"), "path").filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return body.groupBy("path", "name", "kind", "line_start", "line_end").agg(joined.alias("body")).orderBy("path", "line_start")


def status(files: DataFrame) -> DataFrame:
    """Counts over the corpus in one row."""
    lines = F.size(X.lines_of(F.col("content")))
    return files.agg(
        F.count("*").alias("files"), F.sum(lines).cast("bigint").alias("lines"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.countDistinct("language").alias("languages")
    )
