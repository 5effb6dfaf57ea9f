"""Graph sinks: GraphML, Cypher and JSON as rows of text, so that any text writer can store them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X


def limited(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = 1000, max_edges: int | None = 3000, both_ends: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id and edges by ends; both_ends drops edges whose ends were cut."""
    if max_nodes is not None:
        nodes = nodes.orderBy("id").limit(max_nodes)
    if both_ends:
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    if max_edges is not None:
        edges = edges.orderBy("source", "target", "relation").limit(max_edges)
    return nodes, edges


def graphml(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = 1000, max_edges: int | None = 3000) -> DataFrame:
    """line and its order, section first: header, nodes, edges, footer."""
    spark = nodes.sparkSession
    nodes, edges = limited(nodes, edges, max_nodes, max_edges)
    e = X.xml_escape
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">']
    fixed = spark.createDataFrame([(0, f"{k}", x) for k, x in enumerate(head)] + [(3, "0", "</graph>"), (3, "1", "</graphml>")], "section int, place string, line string")
    node = nodes.select(F.lit(1).alias("section"), F.col("id").alias("place"), F.concat(F.lit('<node id="'), e(F.col("id")), F.lit('"><data key="label">'), e(F.col("label")), F.lit('</data><data key="type">'), e(F.col("type")), F.lit("</data></node>")).alias("line"))
    edge = edges.select(F.lit(2).alias("section"), F.concat_ws(" ", "source", "target", "relation").alias("place"), F.concat(F.lit('<edge source="'), e(F.col("source")), F.lit('" target="'), e(F.col("target")), F.lit('"><data key="relation">'), e(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return fixed.unionByName(node).unionByName(edge)


def cypher(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = 1000, max_edges: int | None = 3000) -> DataFrame:
    """MERGE statements: section, place and line."""
    nodes, edges = limited(nodes, edges, max_nodes, max_edges)
    q = X.cypher_escape
    node = nodes.select(F.lit(1).alias("section"), F.col("id").alias("place"), F.concat(F.lit("MERGE (n:"), X.cypher_name(F.col("type")), F.lit(" {id: '"), q(F.col("id")), F.lit("'}) SET n.label = '"), q(F.col("label")), F.lit("';")).alias("line"))
    edge = edges.select(F.lit(2).alias("section"), F.concat_ws(" ", "source", "target", "relation").alias("place"), F.concat(F.lit("MATCH (a {id: '"), q(F.col("source")), F.lit("'}), (b {id: '"), q(F.col("target")), F.lit("'}) MERGE (a)-[:"), X.cypher_name(F.col("relation"), True), F.lit("]->(b);")).alias("line"))
    return node.unionByName(edge)


def json_lines(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = 1000, max_edges: int | None = 3000) -> DataFrame:
    """A JSON object for each node and edge; edges keep ends that were cut."""
    nodes, edges = limited(nodes, edges, max_nodes, max_edges, both_ends=False)
    node = nodes.select(F.lit(1).alias("section"), F.col("id").alias("place"), F.to_json(F.struct("id", "label", "type")).alias("line"))
    edge = edges.select(F.lit(2).alias("section"), F.concat_ws(" ", "source", "target", "relation").alias("place"), F.to_json(F.struct("source", "target", "relation")).alias("line"))
    return node.unionByName(edge)


def write_text(lines: DataFrame, path: str) -> None:
    """The export as text files in order of section and place."""
    lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)


def snapshot(files: DataFrame, deps: DataFrame, seq: int = 1) -> DataFrame:
    """One JSON row a file: its path, language, dependencies and dependents."""
    out = deps.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    into = deps.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast("array<string>")
    rows = files.select("path", "language").join(out, "path", "left").join(into, "path", "left")
    return rows.select("path", F.to_json(F.struct("path", "language", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("imported_by", none).alias("imported_by"), F.lit(seq).alias("seq"))).alias("line"))
