"""Modules of files: discovery over dependencies, terms, central files, confidence and maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators.graph import components

# Fixed word lists and values of the scores.
NOUNS = ("manager", "controller", "service", "listener", "handler", "router", "view", "panel", "system", "facade", "module", "model", "repository", "processor", "factory")
LIFECYCLE = ("awake", "start", "init", "initialize", "run", "execute", "process", "update")
FOLDERS = ("controller", "controllers", "manager", "managers", "service", "services", "view", "views")
BUSINESS_KINDS = ("class", "interface", "struct", "record", "method", "function", "constructor")
KIND_SCORES = {"class": 8, "interface": 8, "struct": 8, "enum": 8, "record": 8, "method": 4, "constructor": 4, "function": 4, "property": 2, "field": 2}
TERM_STOPWORDS = (
    "asset assets base build cache client code common component components config core data default editor factory file framework game generated global helper helpers "
    "hot hotfix impl index item items lib library list logic main manager model module modules object package packages plugin runtime script scripts service simple "
    "system test tests type types util utils view views"
).split()
TYPE_KINDS = ("class", "interface", "struct", "enum", "record")


def capped_edges(deps: DataFrame, hub: int = 220, per_file: int = 72) -> DataFrame:
    """Dependencies without those into hubs, and the first targets of each file."""
    deps = deps.filter("src <> dst").distinct()
    hubs = deps.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return deps.join(hubs, "dst", "left_anti").withColumn("place", place).filter(F.col("place") <= per_file).select("src", "dst")


def discover(files: DataFrame, deps: DataFrame, hub: int = 220, per_file: int = 72, rounds: int = 8, largest: int = 450) -> DataFrame:
    """path and module: ordered label votes within each component of capped edges; oversized modules are cut by path root and size."""
    edges = capped_edges(deps, hub, per_file)
    nodes = files.select(F.col("path").alias("id"))
    comps = components(nodes, edges.select(F.col("src").alias("source"), F.col("dst").alias("target")))
    own = edges.join(comps.select(F.col("id").alias("src"), "component"), "src")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        into: dict[str, list[str]] = {}
        for a, b in zip(part["src"], part["dst"], strict=True):
            out.setdefault(a, []).append(b)
            into.setdefault(b, []).append(a)
        names = sorted({*out, *into}, key=lambda v: (-(len(out.get(v, ())) + len(into.get(v, ()))), v))
        label = {v: v for v in names}
        for _ in range(rounds):
            moved = False
            for v in names:
                votes = {label[v]: 2.5}
                for near, weight in ((out.get(v, ()), 6.0), (into.get(v, ()), 4.0)):
                    for u in near:
                        votes[label[u]] = votes.get(label[u], 0.0) + weight
                best = min(votes, key=lambda c: (-votes[c], c))
                moved |= best != label[v]
                label[v] = best
            if not moved:
                break
        return pd.DataFrame({"path": list(label), "module": list(label.values())})

    found = own.groupBy("component").applyInPandas(work, "path string, module string")
    placed = files.select("path").join(found, "path", "left").withColumn("module", F.coalesce("module", "path"))
    sized = placed.withColumn("size", F.count("*").over(Window.partitionBy("module")))
    root = F.when(F.col("size") > largest, X.path_root(F.col("path"))).otherwise("")
    place = F.row_number().over(Window.partitionBy("module", "root").orderBy("path")) - 1
    cut = sized.withColumn("root", root).withColumn("slice", F.when(F.col("size") > largest, F.floor(place / largest)).otherwise(0).cast("string"))
    return cut.select("path", F.when(F.col("size") > largest, F.concat_ws("#", "module", "root", "slice")).otherwise(F.col("module")).alias("module"))


def is_term(token: Column) -> Column:
    """Three bytes or more, a letter among them, no common word."""
    return (F.octet_length(token) >= 3) & token.rlike("[A-Za-z]") & ~token.isin(*TERM_STOPWORDS)


def term_counts(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """path, term, count: path pieces and imports count once, namespaces twice, type symbols four times and other symbols twice.

    files holds path and, if they are known, namespace and imports.
    """

    def terms(frame: DataFrame, words: Column, weight: Column) -> DataFrame:
        parts = F.flatten(F.transform(F.filter(words, lambda w: w != ""), X.split_identifier))
        return frame.select("path", F.explode(parts).alias("term"), weight.alias("w"))

    out = terms(files, F.split("path", r"[/. +_-]"), F.lit(1))
    if "namespace" in files.columns:
        out = out.unionByName(terms(files, F.split("namespace", r"\."), F.lit(2)))
    if "imports" in files.columns:
        out = out.unionByName(terms(files, F.flatten(F.transform("imports", lambda i: F.split(i, r"[/.: +_-]"))), F.lit(1)))
    if symbols is not None:
        out = out.unionByName(terms(symbols, F.array("name"), F.when(F.col("kind").isin(*TYPE_KINDS), 4).otherwise(2)))
    return out.filter(is_term(F.col("term"))).groupBy("path", "term").agg(F.sum("w").alias("count"))


def ranked_terms(counts: DataFrame, members: DataFrame, top: int = 12, counted: bool = False) -> DataFrame:
    """module, term, score, rank, and the count if `counted`: count * ln(1 + modules / modules with the term), in hundredths; ties by count, then term."""
    held = counts.join(members, "path").groupBy("module", "term").agg(F.sum("count").alias("count"))
    total = members.agg(F.countDistinct("module").alias("modules"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    scored = held.join(df, "term").crossJoin(F.broadcast(total)).withColumn("score", F.round(F.col("count") * F.log1p(F.col("modules") / F.col("df")), 2))
    order = Window.partitionBy("module").orderBy(F.desc("score"), F.desc("count"), "term")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("module", "term", "score", "rank", *(["count"] if counted else []))


def labels(terms: DataFrame) -> DataFrame:
    """module and its label: the two best terms."""
    best = terms.filter("rank <= 2").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return best.select("module", F.array_join(F.transform("t", lambda x: x["term"]), "/").alias("label"))


def edge_counts(members: DataFrame, deps: DataFrame) -> DataFrame:
    """module, files, internal, outgoing, incoming and cohesion (internal over all that touch it; 1 with none)."""
    a, b = members.select(F.col("path").alias("src"), F.col("module").alias("ma")), members.select(F.col("path").alias("dst"), F.col("module").alias("mb"))
    both = deps.join(a, "src").join(b, "dst")
    side = both.select(F.explode(F.when(F.col("ma") == F.col("mb"), F.array(F.struct(F.col("ma").alias("module"), F.lit(0).alias("k")))).otherwise(F.array(F.struct(F.col("ma").alias("module"), F.lit(1).alias("k")), F.struct(F.col("mb").alias("module"), F.lit(2).alias("k"))))).alias("x"))
    n = lambda k: F.sum((F.col("x.k") == k).cast("bigint"))
    counted = side.groupBy("x.module").agg(n(0).alias("internal"), n(1).alias("outgoing"), n(2).alias("incoming"))
    out = members.groupBy("module").agg(F.count("*").alias("files")).join(counted, "module", "left").fillna({"internal": 0, "outgoing": 0, "incoming": 0})
    touch = F.col("internal") + F.col("outgoing") + F.col("incoming")
    return out.withColumn("cohesion", F.round(F.when(touch == 0, 1.0).otherwise(F.col("internal") / touch), 6))


def central_files(members: DataFrame, deps: DataFrame, symbols: DataFrame, top: int = 5) -> DataFrame:
    """module, path, score, rank: three times internal edges, external edges and symbols."""
    m = members.select("path", "module")
    a, b = m.select(F.col("path").alias("src"), F.col("module").alias("ma")), m.select(F.col("path").alias("dst"), F.col("module").alias("mb"))
    gain = F.when(F.col("ma") == F.col("mb"), 3).otherwise(1)
    ends = deps.join(a, "src").join(b, "dst").select(F.explode(F.array("src", "dst")).alias("path"), gain.alias("g"))
    score = ends.groupBy("path").agg(F.sum("g").alias("g"))
    held = symbols.groupBy("path").agg(F.count("*").alias("s"))
    out = m.join(score, "path", "left").join(held, "path", "left").withColumn("score", (F.coalesce("g", F.lit(0)) + F.coalesce("s", F.lit(0))).cast("bigint"))
    order = Window.partitionBy("module").orderBy(F.desc("score"), "path")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("module", "path", "score", "rank")


def business_bonus(name: Column) -> Column:
    """Three for each business noun in the name."""
    low = F.lower(name)
    return sum((F.when(low.contains(noun), 3).otherwise(0) for noun in NOUNS), F.lit(0))


def entry_points(symbols: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """module, name, path, score, rank of symbols that look like entries: business nouns, lifecycle names, handlers, folders. Others have no place."""
    low = F.lower("name")
    score = F.when(F.col("kind").isin(*BUSINESS_KINDS), business_bonus(F.col("name"))).otherwise(0)
    score = score + F.when(low.isin(*LIFECYCLE), 4).otherwise(0) + F.when(low.startswith("on") | low.startswith("handle"), 3).otherwise(0)
    score = score + F.when(F.lower("path").rlike(f"/(?:{'|'.join(FOLDERS)})/"), 2).otherwise(0)
    out = symbols.join(members, "path").withColumn("score", score.cast("bigint")).filter("score > 0")
    order = Window.partitionBy("module").orderBy(F.desc("score"), "path", "line_start", "name")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("module", "name", "path", "score", "rank")


def key_symbols(symbols: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """module, name, kind, path, line_start, score, rank of the most important symbols: by kind and business nouns."""
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in KIND_SCORES.items() for x in pair)), "kind"), F.lit(1))
    out = symbols.join(members, "path").withColumn("score", (kind + business_bonus(F.col("name"))).cast("bigint"))
    order = Window.partitionBy("module").orderBy(F.desc("score"), "name", "path", "line_start")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("module", "name", "kind", "path", "line_start", "score", "rank")


def languages(files: DataFrame, members: DataFrame) -> DataFrame:
    """module, language, files: how many files of each language a module has."""
    return members.select("path", "module").join(files.select("path", "language"), "path").groupBy("module", "language").agg(F.count("*").alias("files"))


def confidence(counted: DataFrame, entries: DataFrame, members: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """module and confidence from cohesion, semantic density, size, entry points and whether it spans folders, 0 to 1 in hundredths."""
    e = entries.groupBy("module").agg(F.count("*").alias("entries"))
    out = counted.join(e, "module", "left").fillna({"entries": 0})
    out = out.join(density, "module", "left").fillna({"density": 0.0}) if density is not None else out.withColumn("density", F.lit(0.0))
    roots = members.groupBy("module").agg((F.countDistinct(X.path_root(F.col("path"))) > 1).alias("cross"))
    out = out.join(roots, "module", "left")
    score = 0.35 * F.col("cohesion") + 0.25 * F.col("density") + F.least(F.log1p("files") / 5, F.lit(0.35)) + F.least(0.03 * F.col("entries"), F.lit(0.15)) + F.when(F.col("cross"), 0.05).otherwise(0.0)
    return out.select("module", "files", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("confidence"))


def path_roots(members: DataFrame, top: int = 3) -> DataFrame:
    """module, root, files, rank of the folders a module's files come from."""
    n = members.groupBy("module", X.path_root(F.col("path")).alias("root")).agg(F.count("*").alias("files"))
    order = Window.partitionBy("module").orderBy(F.desc("files"), "root")
    return n.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)


def module_map(files: DataFrame, deps: DataFrame, symbols: DataFrame, limit: int = 40, min_files: int = 2, prefix: str = "", **options) -> DataFrame:
    """module, label, files, cohesion, confidence, rank of the best modules."""
    own = files.filter(X.under(F.col("path"), prefix))
    members = discover(own, deps, **options)
    big = members.join(members.groupBy("module").agg(F.count("*").alias("n")).filter(F.col("n") >= min_files).select("module"), "module", "left_semi").select("path", "module")
    counted = edge_counts(big, deps)
    entries = entry_points(symbols, big)
    scored = confidence(counted, entries, big).join(counted.select("module", "cohesion"), "module").join(labels(ranked_terms(term_counts(own, symbols), big)), "module", "left")
    order = Window.orderBy(F.desc("confidence"), F.desc("files"), "module")
    # the k best of a row a module
    return scored.orderBy(F.desc("confidence"), F.desc("files"), "module").limit(limit).withColumn("rank", F.row_number().over(order).cast("bigint"))


def layout_edges(members: DataFrame, deps: DataFrame, least: int = 2) -> DataFrame:
    """a, b, weight: undirected counts of dependencies between modules."""
    a, b = members.select(F.col("path").alias("src"), F.col("module").alias("ma")), members.select(F.col("path").alias("dst"), F.col("module").alias("mb"))
    both = deps.join(a, "src").join(b, "dst").filter("ma <> mb")
    return both.groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def viewer_edges(deps: DataFrame, top: int = 8) -> DataFrame:
    """src, dst, rank: the targets of each file that are linked most."""
    degree = deps.select(F.explode(F.array("src", "dst")).alias("dst")).groupBy("dst").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("src").orderBy(F.desc("degree"), "dst")
    return deps.distinct().join(degree, "dst").withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("src", "dst", "rank")
