"""Uses of a definition: identifier postings, cut by an anti join with definition sites, visibility, and the shape of the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.code import is_reference_udf, strip_callers_udf
from sparkloom.operators.deps import visible


def candidates(hits: DataFrame, lines: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """name, path, line, text of lines with a target's name that define no symbol of that name. Stays in built-in functions."""
    named = hits.join(targets.select("name").distinct(), hits["word"] == F.col("name"), "left_semi").withColumnRenamed("word", "name")
    sites = symbols.select("name", "path", F.col("line_start").alias("line"))
    return named.join(sites, ["name", "path", "line"], "left_anti").join(lines.select("path", "line", "text"), ["path", "line"])


def callers(hits: DataFrame, lines: DataFrame, parsed: DataFrame, targets: DataFrame, excluded: list[tuple[str, str]] | None = None, limit: int | None = 50) -> DataFrame:
    """name, target_path, path, line, text of likely uses of each target (name, path, namespace, kind).

    A use is visible: in the same file or namespace, imported, or qualified in its line. excluded holds (path prefix of
    users, path prefix of targets) pairs that never refer to each other.
    """
    symbols = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.line_start")
    own = parsed.select("path", F.col("namespace").alias("space"), "imports")
    t = targets.select("name", F.col("path").alias("target_path"), F.col("namespace").alias("t_space"), "kind")
    found = candidates(hits, lines, symbols, targets).join(own, "path").join(t, "name")
    flat = F.regexp_replace(F.regexp_replace("text", "::", "."), r"\s+", "")
    seen = (F.col("path") == F.col("target_path")) | F.col("t_space").isNull() | F.col("space").eqNullSafe(F.col("t_space")) | visible(F.col("imports"), F.col("t_space"), F.col("name")) | flat.contains(F.concat_ws(".", "t_space", "name"))
    for user, target in excluded or []:
        seen &= ~(F.col("path").startswith(user) & ~F.col("target_path").startswith(target))
    out = found.filter(seen).withColumn("code", strip_callers_udf("text")).filter(is_reference_udf("code", "name", "t_space", "kind"))
    out = out.select("name", "target_path", "path", "line", "text").orderBy("name", "target_path", "path", "line")
    return out.limit(limit) if limit else out


def target_of(symbols: DataFrame, name: str, path: str | None = None, line: int | None = None) -> DataFrame:
    """The definitions a request may mean, 21 at most: none is not found, more than one is ambiguous."""
    out = symbols.filter(F.col("name") == name)
    if path is not None:
        out = out.filter(F.col("path") == path)
    if line is not None:
        out = out.filter(F.col("line_start") == line)
    return out.orderBy("path", "line_start").limit(21)
