"""Reading source trees through Spark's own readers, so that any file system Spark knows will do."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.globs import glob_to_regex, ignore_rules

# Folders that are never scanned, and what a scan reads if nothing else is asked for.
SKIPPED = (".git", ".hg", ".svn", ".idea", ".vs", ".vscode", "node_modules")
EXTENSIONS = tuple(X.LANGUAGES)
#: A zero byte among the first so many marks a binary file.
BINARY_HEAD = 8192


@dataclass
class ScanOptions:
    extensions: tuple[str, ...] = EXTENSIONS
    root_paths: tuple[str, ...] = ()
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    skip_dirs: tuple[str, ...] = ()
    respect_gitignore: bool = True
    max_file_bytes: int = 2 << 20
    extra: dict = field(default_factory=dict)


def load_options(toml_text: str) -> ScanOptions:
    """Scan options of a TOML text: separators become slashes, extensions lower-case, comma lists and arrays both count."""
    raw = tomllib.loads(toml_text)
    scan = raw.get("scan", raw)

    def many(*names: str) -> tuple[str, ...]:
        value = next((scan[n] for n in names if n in scan), ())
        items = value.split(",") if isinstance(value, str) else value
        return tuple(clean for x in items if (clean := str(x).strip().replace("\\", "/").removeprefix("./").strip("/")))

    extensions = tuple(x.lower().lstrip(".") for x in many("extensions")) or EXTENSIONS
    return ScanOptions(
        extensions, many("root_paths", "roots", "source_roots"), many("include_paths"), many("exclude_paths", "exclude_globs"),
        tuple(x.lower() for x in many("skip_dirs")), bool(scan.get("respect_gitignore", True)), int(scan.get("max_file_bytes", 2 << 20)),
    )


def kept(path: Column, options: ScanOptions, root: str = "") -> Column:
    """Whether a relative path lies in scope; skipped folder names count below `root` only."""
    below = F.substring(path, F.lit(len(root) + 2), F.octet_length(path)) if root else path
    folders = F.slice(F.split(F.lower(below), "/"), F.lit(1), F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    names = F.array(*map(F.lit, (*SKIPPED, *options.skip_dirs)))
    out = ~F.arrays_overlap(folders, names) & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*options.extensions)
    for pattern in options.exclude_paths:
        out &= ~path.rlike(glob_to_regex(pattern)) & ~path.rlike(glob_to_regex(pattern.rstrip("/") + "/**"))
    return out


def in_scope(listing: DataFrame, options: ScanOptions, ignore_text: str = "") -> DataFrame:
    """Rows of listing (path relative to the root, …) that a scan reads: roots by ignore rules, included folders without them."""
    path, rules = F.col("path"), ignore_rules(ignore_text) if options.respect_gitignore else []
    dropped = F.lit(False)
    for regex, drop in rules:
        dropped = F.when(path.rlike(regex), F.lit(drop)).otherwise(dropped)
    roots = F.lit(True)
    if options.root_paths:
        roots = F.lit(False)
        for root in options.root_paths:
            roots |= X.under(path, root)
    wanted = roots & kept(path, options) & ~dropped
    for root in options.include_paths:
        wanted |= X.under(path, root) & kept(path, options, root)
    return listing.filter(wanted)


def read_tree(spark: SparkSession, root: str, options: ScanOptions | None = None, ignore_text: str = "") -> DataFrame:
    """path, language, content, line_count, byte_size, modified_ms and content_hash of the tree's source files.

    Sizes above the limit and binary files are left out; bytes that aren't UTF-8 become replacement characters.
    """
    options = options or ScanOptions()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:(//)?", "")
    path = F.expr("substring_index(path, '://', -1)") if "://" in root else F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    rel = F.ltrim(F.regexp_replace(F.replace(path, base, F.lit("")), "^/+", ""))
    out = raw.filter(F.col("length") <= options.max_file_bytes).withColumn("path", rel)
    out = in_scope(out, options, ignore_text).filter(F.instr(F.hex(F.substring("content", 1, BINARY_HEAD)).cast("string"), "00") % 2 != 1)
    text = F.decode("content", "UTF-8")
    out = out.select("path", X.language_of(F.col("path")).alias("language"), text.alias("content"), F.col("length").alias("byte_size"), F.unix_millis("modificationTime").alias("modified_ms"), X.fingerprint(F.col("content")).alias("content_hash"))
    return out.withColumn("line_count", F.size(X.lines_of(F.col("content"))).cast("bigint")).dropDuplicates(["path"])
