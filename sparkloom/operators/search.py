"""Hybrid search: reciprocal ranks, fusion, boosts and penalties over scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import index
from sparkloom.sources import scratch


def reciprocal_ranks(scored: DataFrame, id_col: str, digits: int = 6) -> DataFrame:
    """query_id, id, score: 1 / (60 + rank), best first. Places over all queries less their query's first one: no task sorts a whole query."""
    placed = scratch.numbered(scored.select("query_id", id_col, "score"), "query_id", F.desc("score"), id_col)
    first = placed.groupBy(F.col("query_id").alias("of_query")).agg(F.min("number").alias("first"))
    rank = F.col("number") - F.col("first") + 1
    return placed.join(F.broadcast(first), F.col("query_id").eqNullSafe(F.col("of_query"))).select("query_id", id_col, F.round(1.0 / (60 + rank), digits + 2).alias("score"))


def rank_totals(scored: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, n, total: the sum of a query's reciprocal ranks. Ranks run from 1 to n whatever the order, so rows are counted and not sorted."""
    spark = scored.sparkSession
    # a row a query
    counted = scratch.written(scored.groupBy("query_id").agg(F.count("*").alias("n")))
    most = counted.agg(F.max("n")).first()[0] or 0
    places = spark.range(1, most + 1, 1, scratch.parts(spark, most)).select(F.col("id").alias("place"), F.round(1.0 / (60 + F.col("id")), digits + 2).alias("score"))
    return places.join(F.broadcast(counted), F.col("place") <= F.col("n")).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), digits).alias("total"))


def fuse(lexical: DataFrame, semantic: DataFrame, id_col: str) -> DataFrame:
    """Half of each side's reciprocal rank; a missing side adds nothing."""
    a, b = lexical.withColumnRenamed("score", "a"), semantic.withColumnRenamed("score", "b")
    both = a.join(b, ["query_id", id_col], "full")
    return both.select("query_id", id_col, F.round(0.5 * F.coalesce("a", F.lit(0.0)) + 0.5 * F.coalesce("b", F.lit(0.0)), 8).alias("score"))


def boost_files(scored: DataFrame, id_col: str) -> DataFrame:
    """The best chunk of each file gains a fifth of the top score, by the file's share of the largest file sum (scored has path)."""
    by_query, by_file = Window.partitionBy("query_id"), Window.partitionBy("query_id", "path")
    sums = scored.withColumn("bf_sum", F.sum("score").over(by_file)).withColumn("bf_place", F.row_number().over(by_file.orderBy(F.desc("score"), id_col)))
    gain = 0.2 * F.max("score").over(by_query) * F.col("bf_sum") / F.greatest(F.max("bf_sum").over(by_query), F.lit(1e-6))
    out = sums.withColumn("bf_new", F.round(F.when(F.col("bf_place") == 1, F.col("score") + gain).otherwise(F.col("score")), 8))
    return out.select(*(F.col("bf_new").alias("score") if c == "score" else F.col(c) for c in scored.columns))


def boost_paths(scored: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds the top score times the share of keywords that overlap a part of the file's stem or folder."""
    if not keywords:
        return scored
    parts = F.array_distinct(F.concat(X.split_identifier(X.stem(F.col("path"))), X.split_identifier(X.parent_name(F.col("path")))))

    def meets(word: str) -> Column:
        return F.exists(parts, lambda p: X.prefix_overlap(p, F.lit(word))).cast("double")

    matched = sum(map(meets, keywords), F.lit(0.0))
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("score", F.round(F.col("score") + top * matched / len(keywords), 8))


def query_keywords(query: str) -> list[str]:
    import re

    words = dict.fromkeys(t.lower() for t in re.findall(X.IDENTIFIER, query))
    return [w for w in words if len(w) > 2 and w not in X.STOPWORDS]


def is_symbol_query(query: str) -> bool:
    return " " not in query and ("::" in query or "." in query or "_" in query or any("A" <= c <= "Z" for c in query))


def embedded_symbols(query: str) -> list[str]:
    """Words of more than three characters that mix cases."""
    return [w for w in dict.fromkeys(query.split()) if len(w) > 3 and any(c.isupper() for c in w) and any(c.islower() for c in w)]


def boost_definitions(scored: DataFrame, definitions: DataFrame, id_col: str, name: str, factor: float) -> DataFrame:
    """Chunks that define the name gain factor times the top score, half more where the stem matches; only such may enter anew.

    definitions holds (id, path, name in lower case).
    """
    top = scored.groupBy("query_id").agg(F.max("score").alias("bd_top"))
    multiplier = F.when(X.stem_matches(X.stem(F.col("path")), name), 1.5).otherwise(1.0)
    hits = definitions.filter(F.col("name") == name.lower()).withColumn("bd_by", multiplier).select(id_col, F.col("path").alias("bd_path"), "bd_by")
    gains = hits.distinct().crossJoin(F.broadcast(top))
    both = scored.join(gains, ["query_id", id_col], "full").filter(F.col("score").isNotNull() | (F.col("bd_by") == 1.5))
    gain = F.coalesce(F.lit(factor) * F.col("bd_top") * F.col("bd_by"), F.lit(0.0))
    return both.select("query_id", id_col, F.coalesce("path", "bd_path").alias("path"), F.round(F.coalesce("score", F.lit(0.0)) + gain, 8).alias("score"))


def ranked(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    """query_id, rank, id, path, score: ordered by the penalised score, which is not the score that is reported."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("score") * X.path_penalty(F.col("path")), 8)), "path", id_col)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "path", "score")


def local_scores(file_scores: DataFrame, chunk_terms: DataFrame, query_terms: list[str], per_file: int) -> DataFrame:
    """Chunk scores from file scores: share of query terms in the chunk, damped by the chunk's place in its file."""
    wanted = F.array(*map(F.lit, query_terms or [""]))
    overlap = F.size(F.array_intersect(wanted, F.col("terms"))) / max(len(query_terms), 1)
    local = chunk_terms.join(file_scores.withColumnRenamed("score", "ls_file"), "path").withColumn("ls_local", F.col("ls_file") * (1 + overlap))
    place = F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("ls_local"), "chunk_id"))
    return local.withColumn("ls_place", place).filter(F.col("ls_place") <= per_file).select("query_id", "chunk_id", "path", F.round(F.col("ls_local") / F.col("ls_place"), 8).alias("score"))


def enough(lexical: DataFrame, k: int, meaningful: int) -> bool:
    """Whether a lexical plan alone will do: five to forty hits, as k asks, and two meaningful tokens."""
    need = max(5, min(40, k))
    return meaningful >= 2 and lexical.limit(need).count() >= need


def hybrid(posted: DataFrame, lengths: DataFrame, paths: DataFrame, vectors: DataFrame | None, query: str, query_vector: Column | None, id_col: str, k: int = 50, definitions: DataFrame | None = None, lexical_only: bool | None = None) -> DataFrame:
    """One query: symbol, lexical or fused plan by its shape, then boosts, penalties and the top k. paths has (id, path)."""
    spark = posted.sparkSession
    tokens = spark.range(1).select(F.explode(X.tokenize(F.lit(query))).alias("term")).withColumn("query_id", F.lit(0))
    symbol = is_symbol_query(query)
    n = max(k, k * (12 if symbol else 5))
    lexical = index.top_per_query(index.bm25(posted, lengths, tokens, id_col), id_col, n).select("query_id", id_col, "score")
    plain = symbol or vectors is None or query_vector is None
    if lexical_only is None and not plain:
        lexical_only = enough(lexical, k, len(query_keywords(query)))
    scores = reciprocal_ranks(lexical, id_col)
    if not (plain or lexical_only):
        asked = spark.range(1).select(F.lit(0).alias("query_id"), query_vector.alias("query"))
        near = index.nearest(vectors, asked, n, id_col).select("query_id", id_col, "score")
        scores = fuse(scores, reciprocal_ranks(near, id_col), id_col)
    out = boost_files(scores.join(paths, id_col), id_col)
    if symbol and definitions is not None:
        import re

        out = boost_definitions(out, definitions, id_col, re.split(r"[.:\\]", query)[-1], 3.0)
    elif not symbol:
        out = boost_paths(out, query_keywords(query))
        for name in embedded_symbols(query) if definitions is not None else []:
            out = boost_definitions(out, definitions, id_col, name, 1.5)
    return ranked(out, id_col, k)
