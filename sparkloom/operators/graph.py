"""Typed graphs: building, merging, degrees, reachability, paths, components, lookups and analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.sources.scratch import ROWS, parts, written

RANK = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}
STRUCTURAL = ("contains", "declares_namespace", "depends_on", "imports")
# Fixed word list: path tokens that name no feature.
FEATURE_STOPWORDS = (
    "asset assets activity base btn build button client code com common component components container core csharp csharpframework custom data fix framework game gameview "
    "gen generate generated group handler helper hot hotfix icon info item items list logic lua lua2csharp lua2csharpcode main manager module modules node page pages panel "
    "popup runtime script scripts simple ui util utils view views"
).split()


def symbol_id(path: Column, line: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("symbol"), path, line.cast("string"), name)


def build(files: DataFrame, symbols: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, type, file_path) and merged edges of files (path, namespace), symbols and dependencies (src, dst)."""
    file_id = lambda c: F.concat(F.lit("file:"), c)
    space_id = F.concat(F.lit("namespace:"), F.col("namespace"))
    own = symbol_id(F.col("path"), F.col("line_start"), F.col("name"))
    named = files.filter("namespace IS NOT NULL")
    label = F.when(F.col("kind").isin("method", "constructor"), F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    nodes = (
        files.select(file_id(F.col("path")).alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("file").alias("type"), F.col("path").alias("file_path"))
        .unionByName(named.select(space_id.alias("id"), F.col("namespace").alias("label"), F.lit("namespace").alias("type"), F.lit(None).cast("string").alias("file_path")).distinct())
        .unionByName(symbols.select(own.alias("id"), label.alias("label"), F.col("kind").alias("type"), F.col("path").alias("file_path")))
    )

    def edge(source: Column, target: Column, relation: str, frame: DataFrame) -> DataFrame:
        return frame.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight"))

    edges = (
        edge(file_id(F.col("path")), space_id, "declares_namespace", named)
        .unionByName(edge(file_id(F.col("path")), own, "contains", symbols))
        .unionByName(edge(F.concat(F.lit("namespace:"), F.col("namespace")), own, "contains", symbols.join(named.select("path", "namespace"), "path")))
        .unionByName(edge(file_id(F.col("src")), file_id(F.col("dst")), "depends_on", deps))
    )
    return nodes, merge_edges(edges)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): weights add up, the highest confidence stays, self loops go.

    Of file, line and score, where edges have them, those of the edge of the highest confidence stay; of equals the first by file and line.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), "confidence"), F.lit(0))
    places = [c for c in ("file", "line", "score") if c in edges.columns]
    order = F.struct(-rank, *(F.col(c) for c in places))
    best = F.min_by(F.struct("confidence", *places), order).alias("best") if places else F.max_by(F.struct("confidence"), rank).alias("best")
    merged = edges.filter("source <> target").groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"), F.count("*").alias("merge_count"), best)
    return merged.select("source", "target", "relation", "weight", "merge_count", "best.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and degree (edges in and out), 0 for isolated nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna({"degree": 0})


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    held = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.sum((F.col("degree") == 0).cast("bigint")).alias("isolated"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("mean_degree"))
    return held.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def reverse(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reachable(deps: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start and node reachable over src to dst; a start is in its own result only if it lies on a cycle.

    A frontier loop: each step joins the new nodes only, and those seen before leave by an anti join.
    """
    deps = written(deps.distinct())
    front = starts.select(F.col("node").alias("start"), "node")
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        step = front.join(deps, front["node"] == deps["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = written(step if seen is None else step.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = front if seen is None else written(seen.unionByName(front))
        depth += 1
    return seen if seen is not None else starts.select(F.col("node").alias("start"), "node").limit(0)


def hops(edges: DataFrame, source: str, max_depth: int = 8) -> DataFrame:
    """node and hops from source, direction ignored; the source has 0."""
    edges = written(edges.select("source", "target"))
    tasks = parts(edges.sparkSession, 2 * edges.count())
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    both = written(both.repartition(tasks, "a").distinct())
    front = edges.sparkSession.createDataFrame([(source,)], "node string").join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi").withColumn("hops", F.lit(0).cast("bigint"))
    seen = written(front)
    front = seen
    for k in range(1, max_depth + 1):
        step = front.join(both.repartition(tasks, "a"), F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k).cast("bigint")))
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front))
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 8) -> DataFrame:
    """step and node of one shortest path: of equal ones each node's least predecessor. Empty if there is none."""
    edges = written(edges.select("source", "target"))
    near = hops(edges, source, max_depth)
    found = near.filter(F.col("node") == target).first()
    spark = edges.sparkSession
    if found is None:
        return spark.createDataFrame([], "step bigint, node string")
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    path, at = [target], target
    for k in range(int(found["hops"]) - 1, -1, -1):
        # a row a step: the path has at most max_depth steps
        at = both.filter(F.col("b") == at).join(near.filter(F.col("hops") == k), F.col("a") == F.col("node")).agg(F.min("a")).first()[0]
        path.append(at)
    return spark.createDataFrame(list(enumerate(reversed(path))), "step bigint, node string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its least id): labels spread over edges, then shortcut through their own labels, until nothing changes."""
    both = written(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).filter("a <> b").distinct())
    labels = written(nodes.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(seen, labels["id"] == seen["a"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        hop = step.select(F.col("id").alias("via"), F.col("component").alias("far"))
        new = written(step.join(hop, step["component"] == hop["via"]).select("id", F.least("component", "far").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty()
        labels = new
        if changed:
            return labels


def best_node(nodes: DataFrame, degree: DataFrame, term: str) -> DataFrame:
    """The node that fits a term best: equal 1000, contained 100, and 10 and 5 for each word in label and id."""
    label, key, want = F.lower("label"), F.lower("id"), term.lower()
    score = F.when((label == want) | (key == want), 1000).otherwise(0) + F.when(label.contains(want) | key.contains(want), 100).otherwise(0)
    for word in want.split():
        score = score + F.when(label.contains(word), 10).otherwise(0) + F.when(key.contains(word), 5).otherwise(0)
    return nodes.join(degree, "id").withColumn("score", score.cast("bigint")).filter("score > 0").orderBy(F.desc("score"), F.desc("degree"), "id").limit(1).select("id", "label", "degree", "score")


def explain(edges: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """direction, relation, other and weight of a node's edges, each direction up to the limit."""
    out = edges.filter(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("other"), "weight")
    into = edges.filter(F.col("target") == node).select(F.lit("in").alias("direction"), "relation", F.col("source").alias("other"), "weight")
    return out.orderBy("other", "relation").limit(limit).unionByName(into.orderBy("other", "relation").limit(limit))


def top_nodes(nodes: DataFrame, degree: DataFrame, n: int = 10) -> DataFrame:
    return nodes.filter("type <> 'file'").join(degree, "id").orderBy(F.desc("degree"), "id").limit(n).select("id", "label", "degree")


def surprising(nodes: DataFrame, edges: DataFrame, communities: DataFrame, n: int = 10) -> DataFrame:
    """Edges across directories and communities, and from hubs to leaves, by points; structural relations don't count."""
    held = degrees(nodes, edges)
    side = nodes.join(held, "id").join(communities, "id", "left").select("id", F.split_part("file_path", F.lit("/"), F.lit(1)).alias("top"), "community", "degree")
    a, b = (side.select(*(F.col(c).alias(f"{p}_{c}") for c in side.columns)) for p in ("a", "b"))
    both = edges.filter(~F.col("relation").isin(*STRUCTURAL)).join(a, F.col("source") == F.col("a_id")).join(b, F.col("target") == F.col("b_id"))
    low, high = F.least("a_degree", "b_degree"), F.greatest("a_degree", "b_degree")
    points = (
        F.when(F.col("confidence") == "INFERRED", 2).otherwise(1) + F.when(F.col("a_top") != F.col("b_top"), 2).otherwise(0)
        + F.when(F.col("a_community") != F.col("b_community"), 1).otherwise(0) + F.when((low <= 2) & (high >= 5), 1).otherwise(0)
    )
    return both.select("source", "target", "relation", points.cast("bigint").alias("score")).orderBy(F.desc("score"), "source", "target").limit(n)


def questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, n: int = 7) -> DataFrame:
    """kind and subject of what is worth asking: bridges between communities, loose communities and weakly tied nodes."""
    c = communities.select("id", "community")
    a, b = c.select(F.col("id").alias("source"), F.col("community").alias("ca")), c.select(F.col("id").alias("target"), F.col("community").alias("cb"))
    tied = edges.join(a, "source").join(b, "target")
    ends = tied.filter("ca <> cb").select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("cb").alias("other")), F.struct(F.col("target").alias("id"), F.col("ca").alias("other")))).alias("x"))
    bridges = ends.groupBy("x.id").agg(F.countDistinct("x.other").alias("n")).filter("n >= 2").select(F.lit("bridge").alias("kind"), F.col("id").alias("subject"), "n")
    loose = cohesion(communities, edges).filter((F.col("size") >= 20) & (F.col("cohesion") < 0.05)).select(F.lit("loose").alias("kind"), F.col("community").cast("string").alias("subject"), F.col("size").alias("n"))
    weak = degrees(nodes, edges).filter("degree <= 1").select(F.lit("weak").alias("kind"), F.col("id").alias("subject"), F.col("degree").alias("n"))
    return bridges.unionByName(loose).unionByName(weak).orderBy("kind", F.desc("n"), "subject").limit(n)


def cohesion(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, internal edges and their share of all pairs; a lone node counts as whole."""
    c = communities.select("id", "community")
    inside = edges.join(c.select(F.col("id").alias("source"), "community"), "source").join(c.select(F.col("id").alias("target"), F.col("community").alias("other")), "target").filter("community = other")
    sizes = c.groupBy("community").agg(F.count("*").alias("size"))
    out = sizes.join(inside.groupBy("community").agg(F.count("*").alias("internal")), "community", "left").fillna({"internal": 0})
    share = F.when(F.col("size") <= 1, 1.0).otherwise(F.col("internal") / (F.col("size") * (F.col("size") - 1) / 2))
    return out.withColumn("cohesion", F.round(share, 6))


def labels(communities: DataFrame, nodes: DataFrame, depth: int = 2) -> DataFrame:
    """community and the label most members have: the first path parts; the least of equals."""
    parts = F.slice(F.split("file_path", "/"), 1, depth)
    label = F.when(F.size(F.split("file_path", "/")) == 1, F.concat("file_path", F.lit("/"), "type")).otherwise(F.array_join(parts, "/"))
    n = communities.join(nodes, "id").groupBy("community", label.alias("label")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "label"))
    return n.withColumn("place", place).filter("place = 1").select("community", "label", "n")


def split_large(communities: DataFrame, nodes: DataFrame, share: float = 0.25, least: int = 25) -> DataFrame:
    """id, community, part: communities above max(least, share of all nodes) fall apart by path, then into slices of that size."""
    total = communities.agg(F.count("*").alias("total"))
    sized = communities.join(communities.groupBy("community").agg(F.count("*").alias("size")), "community").join(nodes.select("id", "file_path"), "id").crossJoin(F.broadcast(total))
    limit = F.greatest(F.lit(least), F.floor(F.col("total") * share))
    key = F.when(F.col("size") > limit, F.array_join(F.slice(F.split("file_path", "/"), 1, 3), "/")).otherwise("")
    place = F.row_number().over(Window.partitionBy("community", "bucket").orderBy("id")) - 1
    out = sized.withColumn("bucket", key).withColumn("slice", F.when(F.col("size") > limit, F.floor(place / limit)).otherwise(0).cast("bigint"))
    return out.select("id", "community", F.col("bucket").alias("part"), "slice")


def _sent(names: DataFrame) -> DataFrame:
    """A written list of names, to all tasks if it is short."""
    return F.broadcast(names) if names.count() <= ROWS else names


def reference_edges(mentions: DataFrame, symbols: DataFrame, max_definitions: int = 24, per_source: int = 64) -> DataFrame:
    """source and target symbols: names that bodies mention, joined to definitions of names that aren't too common.

    mentions: source, path, name. Of many targets those in the same file come first, then by path.
    """
    few = written(symbols.groupBy("name").agg(F.count("*").alias("definitions")).filter(F.col("definitions") <= max_definitions).select("name"))
    known = symbols.join(few, "name", "left_semi").select(F.col("name"), F.col("path").alias("to_path"), symbol_id(F.col("path"), F.col("line_start"), F.col("name")).alias("target"))
    # names that lead nowhere go before anything is exchanged by source
    hits = mentions.select("source", "path", "name").join(_sent(few), "name", "left_semi").distinct().join(known, "name").filter("source <> target")
    order = Window.partitionBy("source").orderBy((F.col("path") != F.col("to_path")).cast("int"), "to_path", "target")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_source).select("source", "target")


def file_reference_edges(words: DataFrame, symbols: DataFrame, max_files: int = 48, per_file: int = 256) -> DataFrame:
    """src, dst, n: how many of a file's words (path, word) another file defines; words of many files don't count."""
    defined = symbols.select(F.col("name").alias("word"), F.col("path").alias("dst")).distinct()
    rare = written(defined.groupBy("word").agg(F.count("*").alias("in_files")).filter(F.col("in_files") <= max_files).select("word"))
    pairs = words.select("path", "word").join(_sent(rare), "word", "left_semi").distinct().join(defined.join(rare, "word", "left_semi"), "word").filter("path <> dst")
    n = pairs.groupBy(F.col("path").alias("src"), "dst").agg(F.count("*").alias("n"))
    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return n.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_file).drop("place")


def affinity_edges(tokens: DataFrame, low: int = 2, high: int = 512) -> DataFrame:
    """src, dst, token: files that share a path token, tied to the first of them; tokens of too many files don't count."""
    held = tokens.select("path", "token").distinct()
    hubs = held.groupBy("token").agg(F.min("path").alias("dst"), F.count("*").alias("files")).filter(F.col("files").between(low, high))
    return held.join(hubs, "token").filter("path <> dst").select(F.col("path").alias("src"), "dst", "token")


def project_to_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst files and weight of edges between nodes of different files; each relation has its factor and least weight."""
    f = nodes.filter("file_path IS NOT NULL").select("id", "file_path")
    a, b = f.select(F.col("id").alias("source"), F.col("file_path").alias("src")), f.select(F.col("id").alias("target"), F.col("file_path").alias("dst"))
    relation, w = F.col("relation"), F.col("weight")
    weight = (
        F.when(relation.isin("references_file", "module_reference"), F.greatest(w, F.lit(1.0)) * 3).when(relation == "feature_affinity", F.greatest(w, F.lit(0.1)))
        .when(relation == "references", F.greatest(w, F.lit(0.1)) * 2).when(relation == "depends_on", F.greatest(w, F.lit(1.0)))
    )
    out = edges.withColumn("w", weight).filter("w IS NOT NULL").join(a, "source").join(b, "target").filter("src <> dst")
    return out.groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def is_feature_token(token: Column) -> Column:
    """Three bytes or more, a letter among them, no keyword and no common path word."""
    return (F.octet_length(token) >= 3) & token.rlike("[A-Za-z]") & ~token.isin(*X.CODE_STOPWORDS) & ~token.isin(*FEATURE_STOPWORDS)


def _feature_parts(path: Column) -> Column:
    """array of (place, part, tokens) of a path's pieces; of several tokens the whole piece is none."""
    pieces = F.filter(F.split(path, "[^A-Za-z0-9_]+"), lambda p: p != "")
    tokens = lambda p: F.when(F.size(X.split_identifier(p)) > 1, F.slice(X.split_identifier(p), F.lit(2), F.size(X.split_identifier(p)))).otherwise(X.split_identifier(p))
    return F.transform(pieces, lambda p, k: F.struct(k.alias("place"), F.lower(p).alias("part"), F.filter(tokens(p), is_feature_token).alias("tokens")))


def path_tokens(files: DataFrame) -> DataFrame:
    """path and token of the distinct feature tokens of a path's pieces."""
    return files.select("path", F.explode(F.array_distinct(F.flatten(F.transform(_feature_parts(F.col("path")), lambda x: x["tokens"])))).alias("token"))


def feature_keys(groups: DataFrame) -> DataFrame:
    """community and token: the feature of each community's files (community, path): tokens gain 1, their piece's place, and 12 where they are the piece, 8 where within it."""
    parts = groups.select("community", F.explode(_feature_parts(F.col("path"))).alias("x"))
    each = parts.select("community", "x.place", "x.part", F.explode("x.tokens").alias("token"))
    score = 1 + F.col("place") + F.when(F.col("part") == F.col("token"), 12).when(F.col("part").contains(F.col("token")), 8).otherwise(0)
    sums = each.groupBy("community", "token").agg(F.sum(score).alias("score"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "token"))
    return sums.withColumn("place", place).filter("place = 1").select("community", "token")


def considered(name: Column, own: Column) -> Column:
    """Whether a body's identifier may refer to another symbol: longer than two bytes, with a letter, no keyword, not the symbol's own name."""
    return (name != own) & (F.octet_length(name) > 2) & name.rlike("[A-Za-z]") & ~name.isin(*X.CODE_STOPWORDS)


def distinct_labels(labelled: DataFrame, communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """labelled (community, label, ...) with labels of one community each where files allow: of those that repeat, each gains its main file's rest after the label."""
    n = labelled.groupBy("label").agg(F.count("*").alias("dl_n"))
    files = communities.join(nodes.filter("file_path IS NOT NULL"), "id").groupBy("community", "file_path").agg(F.count("*").alias("c"))
    main = files.groupBy("community").agg(F.min_by("file_path", F.struct(-F.col("c"), "file_path")).alias("dl_file"))
    parts, own = F.split("dl_file", "/"), F.split("label", "/")
    same = F.array_position(F.concat(F.zip_with(F.slice(parts, F.lit(1), F.size(own)), own, lambda a, b: ~F.coalesce(a == b, F.lit(False))), F.array(F.lit(True))), True)
    rest = F.when(same <= F.size(parts), F.array_join(F.slice(parts, same.cast("int"), F.size(parts)), "/")).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"))
    out = labelled.join(n, "label").join(main, "community", "left")
    return out.withColumn("label", F.when((F.col("dl_n") > 1) & F.col("dl_file").isNotNull(), F.concat_ws(" :: ", "label", rest)).otherwise(F.col("label"))).drop("dl_n", "dl_file")


def community_overview(communities: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """community, label, members, files, cohesion and rank of the largest communities."""
    sizes = communities.join(nodes.select("id", "file_path"), "id").groupBy("community").agg(F.count("*").alias("members"), F.countDistinct("file_path").alias("files"))
    named = distinct_labels(labels(communities, nodes).drop("n"), communities, nodes)
    out = sizes.join(named, "community").join(cohesion(communities, edges).select("community", "cohesion"), "community")
    # a row a community, of which only the largest stay
    top = out.orderBy(F.desc("members"), "community").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("members"), "community")).cast("bigint"))


def community_members(communities: DataFrame, nodes: DataFrame, edges: DataFrame, community: str, limit: int = 50) -> DataFrame:
    """id, label, type and degree of one community's members, the best linked ones first."""
    own = communities.filter(F.col("community") == community).select("id")
    held = nodes.join(own, "id", "left_semi")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(own, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    return held.join(ends, "id", "left").fillna({"degree": 0}).orderBy(F.desc("degree"), "id").limit(limit).select("id", "label", "type", "degree")


def summary(label: Column, kind: Column, incoming: Column, outgoing: Column) -> Column:
    """A sentence about a node's place in the graph."""
    degree = incoming + outgoing
    tie = F.when(degree == 0, "isolated").when(degree == 1, "minimally connected").when(degree < 5, "lightly connected").when(degree < 20, "moderately connected").otherwise("highly connected")
    return F.format_string("`%s` is a %s node that is %s (%d total edges: %d incoming, %d outgoing).", label, kind, tie, degree.cast("bigint"), incoming.cast("bigint"), outgoing.cast("bigint"))
