"""File dependencies: definitions that can be referred to, references in code, and their resolution by joins with residual predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions.code import strip_dependencies_udf

TYPES = ("class", "interface", "struct", "enum", "record", "trait", "type", "symbol")


def definitions(parsed: DataFrame) -> DataFrame:
    """path, language, namespace, name of symbols that other files can depend on.

    Rust: all type symbols. Else: those that match the file's stem, or the only type where none does.
    """
    sym = parsed.select("path", "language", "namespace", F.explode("symbols").alias("s")).filter(F.col("s.kind").isin(*TYPES)).select("path", "language", "namespace", F.col("s.name").alias("name"))
    stem, low = F.lower(F.regexp_replace(X.stem(F.col("path")), "[^A-Za-z0-9]", "")), F.lower("name")
    primary = (stem == low) | ((F.octet_length("name") >= 4) & stem.startswith(low))
    by_file = Window.partitionBy("path")
    marked = sym.distinct().withColumn("primary", primary).withColumn("any", F.max(primary.cast("int")).over(by_file)).withColumn("n", F.count("*").over(by_file))
    return marked.filter((F.col("language") == "rust") | F.col("primary") | ((F.col("any") == 0) & (F.col("n") == 1))).select("path", "language", "namespace", "name")


def references(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, name, qualified (null for plain uses): identifiers, attributes and dotted names of code lines that name a definition.

    Strings, comments, imports and namespace lines don't count.
    """
    lines = files.select("path", "language", F.explode(X.lines_of(F.col("content"))).alias("line"))
    skip = F.col("line").rlike(r"^\s*$|^\s*(//|/\*|\*)|^\s*(using\s+[\w.]+\s*;|using\s+static\b|import\b|from\s+\S+\s+import\b|namespace\b|package\b|use\b|#\s*include\b)")
    code = strip_dependencies_udf("line")
    kept = lines.filter(~skip).select("path", "language", code.alias("code"))
    plain = kept.select("path", F.lit(None).cast("string").alias("qualified"), F.explode(F.array_distinct(X.identifiers(F.col("code")))).alias("name"))
    dotted = kept.select("path", F.explode(F.regexp_extract_all("code", F.lit(r"[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)+"), F.lit(0))).alias("q"))
    # every prefix of a dotted name may be the qualified name of a type
    parts = F.split(X.qualified_name(F.col("q")), r"\.")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.slice(parts, F.lit(1), n))
    qualified = dotted.filter(F.size(parts) >= 2).select("path", F.explode(prefixes).alias("p")).select("path", F.array_join("p", ".").alias("qualified"), F.element_at("p", -1).alias("name"))
    attribute = kept.filter("language = 'csharp'").select("path", F.explode(F.regexp_extract_all("code", F.lit(r"[\[,]\s*([A-Z]\w*)\s*(?=[\](,])"), F.lit(1))).alias("name")).select("path", F.lit(None).cast("string").alias("qualified"), F.concat("name", F.lit("Attribute")).alias("name"))
    named = known.select("name").distinct()
    return plain.unionByName(qualified).unionByName(attribute).distinct().join(named, "name", "left_semi")


def aliases(files: DataFrame) -> DataFrame:
    """path, alias, target of C# alias usings, and of static usings (alias null)."""
    lines = files.filter("language = 'csharp'").select("path", F.explode(X.lines_of(F.col("content"))).alias("line"))
    alias = lines.select("path", F.regexp_extract("line", r"^\s*using\s+(\w+)\s*=\s*([\w.:]+)\s*;", 1).alias("alias"), F.regexp_extract("line", r"^\s*using\s+(\w+)\s*=\s*([\w.:]+)\s*;", 2).alias("target"))
    static = lines.select("path", F.lit(None).cast("string").alias("alias"), F.regexp_extract("line", r"^\s*using\s+static\s+([\w.:]+)\s*;", 1).alias("target"))
    return alias.unionByName(static).filter("target <> ''").withColumn("target", X.qualified_name(F.col("target")))


def visible(imports: Column, namespace: Column, name: Column) -> Column:
    """Whether imports name the namespace, the type in it, or everything in it."""
    return F.exists(imports, lambda i: (i == namespace) | (i == F.concat_ws(".", namespace, name)) | (i == F.concat(namespace, F.lit(".*"))))


def resolve(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """src, dst of every file dependency: names by namespace and import, Rust modules and uses, Lua modules, quoted paths."""
    known = definitions(parsed)
    refs = references(files, known)
    own = parsed.select("path", "language", F.col("namespace").alias("space"), "imports")
    d = known.select(F.col("path").alias("dst"), F.col("language").alias("d_language"), F.col("namespace").alias("d_space"), "name")
    full = F.concat_ws(".", "d_space", "name")
    seen = F.col("qualified").isNull() & (F.col("d_space").isNull() | F.col("space").eqNullSafe(F.col("d_space")) | visible(F.col("imports"), F.col("d_space"), F.col("name")))
    direct = refs.join(own, "path").join(d, "name").filter((F.col("path") != F.col("dst")) & (F.col("language") == F.col("d_language")) & ~F.col("language").isin("rust", "lua", "python"))
    out = direct.filter(seen | (F.col("qualified") == full)).select(F.col("path").alias("src"), "dst")
    by_alias = aliases(files).join(d.withColumn("full", full), F.col("target") == F.col("full")).select(F.col("path").alias("src"), "dst")
    every = out.unionByName(by_alias).unionByName(_rust(files, parsed, known)).unionByName(_by_path(parsed))
    return every.filter("src <> dst").distinct()


def rust_module(path: Column) -> Column:
    """crate.a.b for src/a/b.rs; main, lib and mod name their folder."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(?:.*/)?src/", ""), r"\.rs$", "")
    parts = F.filter(F.split(inner, "/"), lambda p: ~p.isin("main", "lib", "mod"))
    return F.array_join(F.concat(F.array(F.lit("crate")), parts), ".")


def _rust(files: DataFrame, parsed: DataFrame, known: DataFrame) -> DataFrame:
    rust = parsed.filter("language = 'rust'").withColumn("module", rust_module(F.col("path")))
    uses = rust.select(F.col("path").alias("src"), F.explode("imports").alias("u"))
    d = known.filter("language = 'rust'").select(F.col("path").alias("dst"), F.concat_ws(".", rust_module(F.col("path")), F.col("name")).alias("u"))
    modules = rust.select(F.col("path").alias("dst"), F.col("module").alias("u"))
    # `mod x;` names the first file that exists of x.rs and x/mod.rs beside, or below, the declaring file
    lines = files.filter("language = 'rust'").select("path", F.explode(X.lines_of(F.col("content"))).alias("line"))
    mod = lines.select("path", F.regexp_extract("line", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", 1).alias("m")).filter("m <> ''")
    folder = F.regexp_replace("path", "[^/]*$", "")
    base = F.when(X.stem(F.col("path")).isin("main", "lib", "mod"), folder).otherwise(F.concat(folder, X.stem(F.col("path")), F.lit("/")))
    tries = mod.select("path", F.posexplode(F.array(F.concat(base, "m", F.lit(".rs")), F.concat(base, "m", F.lit("/mod.rs")))).alias("place", "dst"), "m")
    exist = tries.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy("path", "m").agg(F.min_by("dst", "place").alias("dst")).select(F.col("path").alias("src"), "dst")
    return uses.join(d, "u").select("src", "dst").unionByName(uses.join(modules, "u").select("src", "dst")).unionByName(exist)


def _by_path(parsed: DataFrame) -> DataFrame:
    """Lua modules by path or path end, Python modules, quoted and included paths relative to the file."""
    paths = parsed.select(F.col("path").alias("dst"))
    wanted = parsed.select(F.col("path").alias("src"), "language", F.explode("imports").alias("i"))
    dotted = F.regexp_replace("i", r"\.", "/")
    folder = F.regexp_replace("src", "/?[^/]*$", "")
    here = F.regexp_replace(F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace("i", r"^\./", "")), r"[^/]+/\.\./", "")
    options = (
        F.when(F.col("language") == "lua", F.array(F.concat(dotted, F.lit(".lua")), F.concat(dotted, F.lit("/init.lua"))))
        .when(F.col("language") == "python", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
        .when(F.col("language").isin("javascript", "typescript"), F.transform(F.array(*map(F.lit, ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"))), lambda x: F.concat(here, x)))
        .when(F.col("language").isin("c", "cpp"), F.array(here, F.col("i")))
    )
    tries = wanted.filter(options.isNotNull()).select("src", "i", "language", F.posexplode(options).alias("place", "want"))
    exact = tries.join(paths, tries["want"] == paths["dst"]).select("src", "i", "place", "dst")
    # path ends as an equi-join: every path under each of its own ends
    parts = F.split("dst", "/")
    ends = paths.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("want"))
    missing = tries.filter(F.col("language").isin("lua", "python", "c", "cpp")).join(exact.select("src", "i"), ["src", "i"], "left_anti")
    loose = missing.join(ends, "want").groupBy("src", "i", "place").agg(F.min("dst").alias("dst"))
    best = exact.unionByName(loose).groupBy("src", "i").agg(F.min_by("dst", F.struct("place", "dst")).alias("dst"))
    return best.select("src", "dst")
