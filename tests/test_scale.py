"""Steps that must not gather a table in a task: their blocks and ranges against plain counterparts."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import chunks, communities, graph, index, layout, search
from sparkloom.sources import scratch, views

DATA = "/root/testdata/sf0.001"


def plain_louvain(edges, passes=20):
    near = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
    label, degree = {v: v for v in near}, {v: sum(n.values()) for v, n in near.items()}
    weight, total = dict(degree), sum(w for a, b, w in edges if a != b)
    for _ in range(passes):
        moved = False
        for v in sorted(near):
            own, k, ties = label[v], degree[v], {}
            for u, w in near[v].items():
                ties[label[u]] = ties.get(label[u], 0.0) + w
            best, gain = own, 0.0
            for c in sorted(ties):
                g = (ties[c] - ties.get(own, 0.0)) / (2 * total) + (weight[own] - weight[c] - k) * k / (2 * total) ** 2
                if c != own and g > gain + 1e-12:
                    best, gain = c, g
            if best != own:
                weight[own] -= k
                weight[best] += k
                label[v], moved = best, True
        if not moved:
            break
    return label


def test_louvain_holds_no_edges(spark, monkeypatch):
    draw = random.Random(3)
    edges = [(f"{g}{draw.randrange(40)}", f"{g}{draw.randrange(40)}", float(draw.randrange(1, 4))) for g in "xyz" for _ in range(120)]
    frame = spark.createDataFrame(edges, "source string, target string, weight double")
    nodes = frame.select(F.explode(F.array("source", "target")).alias("id")).distinct().unionByName(spark.createDataFrame([("alone",)], "id string"))
    want = plain_louvain(edges) | {"alone": "alone"}
    assert {r["id"]: r["community"] for r in communities.louvain(nodes, frame).collect()} == {v: want.get(v, v) for v in (r["id"] for r in nodes.collect())}
    monkeypatch.setattr(communities.Adjacency, "BLOCK", 3)
    a, b = np.array([1, 1, 1, 4, 7, 7]), np.array([4, 7, 9, 1, 1, 9])
    near = communities.Adjacency((a[k : k + 2], b[k : k + 2], b[k : k + 2] / 2) for k in (0, 2, 4))
    assert not any(isinstance(x, (list, dict)) for x in vars(near).values()) and near.nodes.tolist() == [1, 4, 7]
    assert [(v, n, w) for v, n, w in near] == [(0, [1, 2, 3], [2.0, 3.5, 4.5]), (1, [0], [0.5]), (2, [0, 3], [0.5, 4.5])]


def test_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 10)
    rows = [(k * 37 % 101, k % 3) for k in range(101)]
    got = scratch.numbered(spark.createDataFrame(rows, "a long, b long"), "b", F.desc("a"))
    assert [(r["a"], r["b"]) for r in sorted(got.collect(), key=lambda r: r["number"])] == sorted(rows, key=lambda r: (r[1], -r[0]))
    assert got.agg(F.min("number"), F.max("number"), F.countDistinct("number")).first()[:] == (0, 100, 101)
    assert scratch.numbered(spark.createDataFrame([], "a long"), "a").count() == 0


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_nearest_equals_all_pairs(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(k, [draw.choice((-1.0, 0.0, 1.0, 0.3)) for _ in range(4)], k % 3) for k in range(60)]
    rows += [(70, None, 0), (71, [1.0, 2.0], 0), (72, [float("nan"), 1.0, 0.0, 0.0], 0), (73, [0.0] * 4, 0)]
    vectors = index.normalised(spark.createDataFrame(rows, "unit_id long, embedding array<double>, label int"))
    asked = vectors.filter("unit_id % 7 = 0 OR unit_id > 69").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query"))
    near = lambda frame: sorted((r["query_id"], r["rank"], r["unit_id"], str(r["score"] if r["score"] else 0.0 if r["score"] is not None else None)) for r in frame.collect())
    for k in (1, 5, 100):
        want = near(index.top_per_query(index.similarities(vectors, asked), "unit_id", k))
        assert near(index.nearest(vectors, asked, k)) == want
    monkeypatch.setattr(index, "SLAB", 4)
    assert near(index.nearest(vectors, asked, 100)) == want
    named = vectors.withColumn("unit_id", F.concat(F.lit("u"), F.lpad(F.col("unit_id").cast("string"), 3, "0")))
    assert [(q, n, f"u{v:03}", s) for q, n, v, s in want] == near(index.nearest(named, asked, 100))
    assert index.nearest(vectors, asked.limit(0), 3).count() == 0
    for frame in (index.nearest(vectors, asked, 5), index.similarities(vectors, asked)):
        assert "CartesianProduct" not in plan(frame)


def test_reciprocal_ranks_sort_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 7)
    rows = [(q, k, float(k * 31 % 11)) for q in (1, 2) for k in range(40)]
    scored = spark.createDataFrame(rows, "query_id long, id long, score double")
    ranks = search.reciprocal_ranks(scored, "id")
    assert "Window" not in plan(ranks)
    want = {(q, i): round(1 / (60 + n), 8) for q in (1, 2) for n, (_, i) in enumerate(sorted((-s, i) for p, i, s in rows if p == q), 1)}
    assert {(r["query_id"], r["id"]): r["score"] for r in ranks.collect()} == want


def test_postings_are_counted_where_they_are_cut(spark, monkeypatch):
    monkeypatch.setattr(index, "DOCUMENTS", 2)
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, ""), (1, "beta gamma"), (4, "alpha")], "id long, text string")
    made = index.term_tables(docs, "id", F.col("text"))
    assert sorted(tuple(r) for r in made["postings"].collect()) == [("alpha", 1, 2), ("alpha", 4, 1), ("beta", 1, 2), ("gamma", 1, 1)]
    assert sorted((r["id"], r["doc_len"]) for r in made["lengths"].collect()) == [(1, 5), (1, 5), (2, 0), (3, 0), (4, 1)]


def test_bm25_sums_where_hits_are(spark, monkeypatch):
    draw = random.Random(9)
    posted = spark.createDataFrame([(t, k, draw.randrange(1, 5)) for k in range(50) for t in draw.sample("abcdefgh", 4)], "term string, id long, tf long")
    lengths = index.document_lengths(posted, spark.range(60), "id")
    asked = spark.createDataFrame([(q, t) for q in range(6) for t in draw.choices("abcdefghxy", k=5)], "query_id long, term string")
    scores = index.bm25(posted, lengths, asked, "id")
    top = index.top_per_query(scores, "id", 3)
    rows = sorted(map(tuple, scores.collect()))
    assert "WindowGroupLimit" in plan(top)
    totals = {tuple(r) for r in search.rank_totals(scores).collect()}
    assert totals == {(q, n, round(sum(round(1 / (60 + k), 8) for k in range(1, n + 1)), 6)) for q in range(6) for n in [sum(r[0] == q for r in rows)] if n}
    assert search.rank_totals(scores.limit(0)).count() == 0
    monkeypatch.setattr(index, "HELD", 0)
    assert sorted(map(tuple, index.bm25(posted, lengths, asked, "id").collect())) == rows


def test_graph_steps_grow_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 500)
    edges = views.supply_edges(spark, DATA)
    assert edges.rdd.getNumPartitions() > 8
    assert edges.agg(F.sum("weight")).first()[0] == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    some = edges.filter("source IN ('supplier:1', 'supplier:2')")
    walked = graph.hops(some, "supplier:1", 3)
    first = {r["target"] for r in some.collect() if r["source"] == "supplier:1"}
    assert {r["node"] for r in walked.filter("hops = 1").collect()} == first
    nodes = some.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    got = {r["id"]: r["community"] for r in communities.label_propagation_synchronous(nodes, some, 1).collect()}
    assert {got[p] for p in first} <= {"supplier:1", "supplier:2"}


def test_chunks_by_few_files(spark, monkeypatch):
    files = spark.createDataFrame([(f"p{k}", "\n".join(f"line {j}" for j in range(k))) for k in range(9)] + [("none", None)], "path string, content string")
    symbols = spark.createDataFrame([("p5", 2, 3), ("p8", 1, 8)], "path string, line_start long, line_end long")
    whole = sorted(map(tuple, chunks.chunk_files(files, symbols).collect()))
    assert whole == [(f"p{k}", 1, k) for k in range(1, 9)]
    monkeypatch.setattr(chunks, "FILES", 2)
    assert sorted(map(tuple, chunks.chunk_files(files.coalesce(1), symbols).collect())) == whole


def test_grid_pushes_as_cells_do():
    at = layout._start([f"f{k}" for k in range(300)], 60.0)
    cell = np.floor(at / 8.0).astype(int)
    want = np.zeros_like(at)
    for k, (x, y) in enumerate(cell):
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                own = at[(cell == (x + dx, y + dy)).all(axis=1)]
                if len(own):
                    d = at[k] - own.mean(axis=0)
                    want[k] += 4.8 * len(own) * d / max((d**2).sum(), 1e-3)
    assert np.allclose(layout._push(at, 8.0, 4.8), want)


def test_references_with_and_without_a_list_sent(spark, monkeypatch):
    symbols = spark.createDataFrame([("a", "A", 1), ("b", "B", 1), ("b", "A", 2), ("c", "C", 1), ("c", "C", 1)], "path string, name string, line_start long")
    words = spark.createDataFrame([("a", "B"), ("a", "B"), ("a", "C"), ("b", "A"), ("c", "none")], "path string, word string")
    mentions = words.select(F.col("path").alias("source"), "path", F.col("word").alias("name"))
    both = []
    for rows in (0, 100):
        monkeypatch.setattr(graph, "ROWS", rows)
        both.append((sorted(map(tuple, graph.reference_edges(mentions, symbols).collect())), sorted(map(tuple, graph.file_reference_edges(words, symbols).collect()))))
    edges = [("a", "symbol:b:1:B"), ("a", "symbol:c:1:C"), ("a", "symbol:c:1:C"), ("b", "symbol:a:1:A"), ("b", "symbol:b:2:A")]
    assert both == [(edges, [("a", "b", 1), ("a", "c", 1), ("b", "a", 1)])] * 2
