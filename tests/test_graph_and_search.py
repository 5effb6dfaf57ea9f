import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import atlas, communities, export, graph, index, layout, lookups, search
from sparkloom.plans.pipeline import Tools
from sparkloom.plans.projects import Projects
from sparkloom.sources import store
from sparkloom.streaming import changes


def test_bm25_three_documents(spark):
    posted = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("a", 1, 2), ("c", 2, 1)], "term string, id long, tf long")
    lengths = spark.createDataFrame([(0, 2), (1, 2), (2, 1)], "id long, doc_len long")
    asked = spark.createDataFrame([(0, "a")], "query_id long, term string")
    rows = index.bm25(posted, lengths, asked, "id").orderBy(F.desc("score")).collect()
    idf, avg = math.log(1 + 1.5 / 2.5), 5 / 3
    assert [r["id"] for r in rows] == [1, 0]
    assert rows[0]["score"] == round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / avg)), 6)
    only = spark.createDataFrame([(0,)], "id long")
    assert [r["id"] for r in index.bm25(posted, lengths, asked, "id", only).collect()] == [0]


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "depends_on", "EXTRACTED", 1.0) for a, b in pairs], "source string, target string, relation string, confidence string, weight double")


def test_graph_walks(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]
    nodes = spark.createDataFrame([(n, n.upper(), "t", n) for n in "abcxyz"], "id string, label string, type string, file_path string")
    edges = _edges(spark, pairs)
    deps = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"] for r in graph.reachable(deps, start).collect()} == {"a", "b", "c"}
    assert {r["node"] for r in graph.reachable(deps, start, 1).collect()} == {"b"}
    assert graph.reachable(deps, start, 0).count() == 0
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert [r["node"] for r in graph.shortest_path(edges, "b", "a").orderBy("step").collect()] == ["b", "a"]
    assert graph.shortest_path(edges, "a", "z").count() == 0
    assert graph.best_node(nodes, graph.degrees(nodes, edges), "A").first()["id"] == "a"
    merged = graph.merge_edges(edges.unionByName(edges).unionByName(_edges(spark, [("a", "a")]))).collect()
    assert {(r["source"], r["weight"], r["merge_count"]) for r in merged} == {(a, 2.0, 2) for a, _ in pairs}


def test_two_classes_are_linked(spark):
    files = spark.createDataFrame([("A.cs", None), ("B.cs", "N")], "path string, namespace string")
    symbols = spark.createDataFrame([("A.cs", "A", "class", 1), ("B.cs", "B", "class", 1)], "path string, name string, kind string, line_start long")
    none = spark.createDataFrame([], "src string, dst string")
    nodes, edges = graph.build(files, symbols, none)
    assert nodes.count() == 5 and edges.count() == 4
    mention = spark.createDataFrame([("symbol:A.cs:1:A", "A.cs", "B")], "source string, path string, name string")
    assert [tuple(r) for r in graph.reference_edges(mention, symbols).collect()] == [("symbol:A.cs:1:A", "symbol:B.cs:1:B")]


def test_communities(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    nodes = spark.createDataFrame([(n,) for n in "abcdwxyz"], "id string")
    edges = _edges(spark, pairs)
    found = communities.louvain(nodes, edges)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("wxyz")]
    assert communities.modularity(edges, found) > 0.3
    # in-place votes: ties go to the least label, so one bridge joins two cliques
    assert {r["community"] for r in communities.label_propagation(nodes, edges).collect()} == {"b"}
    assert communities.label_propagation_synchronous(nodes, edges).count() == 8


def test_exports_escape(spark):
    nodes = spark.createDataFrame([("a<", "x'&", "t-t", "a"), ("b", "b", "t", "b")], "id string, label string, type string, file_path string")
    edges = _edges(spark, [("a<", "b"), ("b", "cut")])
    xml = "\n".join(r["line"] for r in export.graphml(nodes, edges).collect())
    assert "a&lt;" in xml and "&apos;&amp;" in xml and "cut" not in xml
    cypher = [r["line"] for r in export.cypher(nodes, edges).collect()]
    assert any("t_t" in x and "x\\'&" in x for x in cypher) and len(cypher) == 3
    assert export.json_lines(nodes, edges).count() == 4


def test_query_shapes():
    assert search.is_symbol_query("Foo") and search.is_symbol_query("a::b") and not search.is_symbol_query("foo bar") and not search.is_symbol_query("foo")
    assert search.embedded_symbols("how does FooBar work") == ["FooBar"]
    assert search.query_keywords("how to find the index of index") == ["find", "index"]


def test_boosts(spark):
    scored = spark.createDataFrame([(0, 1, "a/Foo.cs", 1.0), (0, 2, "a/Foo.cs", 0.5), (0, 3, "b/bar.cs", 0.4)], "query_id long, id long, path string, score double")
    up = {r["id"]: r["score"] for r in search.boost_files(scored, "id").collect()}
    assert up == {1: 1.2, 2: 0.5, 3: round(0.4 + 0.2 * 0.4 / 1.5, 8)}
    known = spark.createDataFrame([(3, "b/bar.cs", "bar"), (9, "c/bar.cs", "bar"), (8, "c/x.cs", "bar")], "id long, path string, name string")
    got = {r["id"]: r["score"] for r in search.boost_definitions(scored, known, "id", "Bar", 3.0).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 4.9, 9: 4.5}


def test_layout_is_deterministic():
    names, ties = [f"m{k}" for k in range(30)], [(f"m{k}", f"m{k // 2}", 2.0) for k in range(1, 30)]
    a, b = layout.relax(names, ties, [3.0] * 30), layout.relax(names, ties, [3.0] * 30)
    assert np.array_equal(a, b) and np.isfinite(a).all() and np.unique(a.round(3), axis=0).shape[0] == 30


def test_changes(spark):
    schema = "path string, content_hash string, size long"
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "1", 3)], schema)
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 5), ("d", "1", 4)], schema)
    found = changes.diff(old, new)
    assert {tuple(r) for r in found.collect()} == {("b", "upsert", 5), ("c", "delete", 0), ("d", "upsert", 4)}
    assert {tuple(r) for r in changes.apply_diff(old, found, new).collect()} == {tuple(r) for r in new.collect()}
    assert changes.diff(old, old).count() == 0


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{s}",) for s in (0, 1, 5)] + [("2024-01-01 00:10:00",), ("2024-01-01 00:20:00",)]
    table = spark.createDataFrame(rows, "ts string").selectExpr("cast(ts as timestamp) ts")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(str(r["start"]), r["events"]) for r in changes.sessions(table).collect()}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = changes.watch(stream, lambda df, _: seen.extend((str(r["start"]), r["events"]) for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert batch == {("2024-01-01 00:00:00", 2), ("2024-01-01 00:00:05", 1), ("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 1)}
    assert set(seen) == {x for x in batch if x[0] < "2024-01-01 00:20"}


def test_store_and_tools(spark, tmp_path):
    files = spark.createDataFrame([("src/a.py", "python", "import b\nclass A:\n  pass\n"), ("b.py", "python", "x = 1\n")], "path string, language string, content string")
    root = str(tmp_path / "index")
    assert store.load(spark, root, "c") is None
    store.save(spark, root, {"files": files}, "c")
    held = store.load(spark, root, "c")["files"]
    assert store.unchanged(held, files, "content") and store.load(spark, root, "other") is None
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("text")).withColumn("line", F.lit(1))
    symbols = spark.createDataFrame([("src/a.py", "A", "class", 2, 3)], "path string, name string, kind string, line_start long, line_end long")
    deps = spark.createDataFrame([("src/a.py", "b.py")], "src string, dst string")
    tools = Tools(files, lines, symbols, deps)
    assert [r["path"] for r in tools.call("glob", {"pattern": "*.py"})] == ["b.py", "src/a.py"]
    assert [r["path"] for r in tools.call("deps", {"path": "b.py"})] == ["src/a.py"]
    assert tools.call("nope").startswith("error:") and tools.call("edit").startswith("error:") and tools.call("find", {}).startswith("error:")
    assert len(tools.schemas()) == len(tools.known)


def test_label_propagation_takes_seeds(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("a", "x/y"), ("b", "x/y"), ("c", "x/y"), ("d", "x/z")], "id string, community string")
    for solve in (communities.label_propagation, communities.label_propagation_synchronous):
        assert dict(map(tuple, solve(nodes, edges, seeds=seeds).select("id", "community").collect())) == {"a": "x/y", "b": "x/y", "c": "x/y", "d": "x/z", "e": "e"}


def test_community_labels_and_features(spark):
    nodes = spark.createDataFrame([("f1", "a", "file", "src/game/Login/LoginView.cs"), ("f2", "b", "file", "src/game/Login/LoginModel.cs"), ("f3", "c", "file", "src/game/Bag/BagItem.cs"), ("s", "S", "class", "src/game/Bag/BagItem.cs")], "id string, label string, type string, file_path string")
    groups = spark.createDataFrame([("f1", "1"), ("f2", "1"), ("f3", "2"), ("s", "2")], "id string, community string")
    labelled = spark.createDataFrame([("1", "src/game"), ("2", "src/game")], "community string, label string")
    got = {r["community"]: r["label"] for r in graph.distinct_labels(labelled, groups, nodes).collect()}
    assert got == {"1": "src/game :: Login/LoginModel.cs", "2": "src/game :: Bag/BagItem.cs"}
    alone = labelled.filter("community = '1'")
    assert graph.distinct_labels(alone, groups, nodes).first()["label"] == "src/game"
    paths = groups.join(nodes, "id").selectExpr("community", "file_path path")
    assert {r["community"]: r["token"] for r in graph.feature_keys(paths).collect()} == {"1": "login", "2": "bag"}
    tokens = graph.path_tokens(nodes.filter("id = 'f1'").selectExpr("file_path path"))
    assert sorted(r["token"] for r in tokens.collect()) == ["login", "src"]
    edges = _edges(spark, [("f1", "f3"), ("s", "f1")])
    over = {r["community"]: tuple(r) for r in graph.community_overview(groups, nodes, edges).select("community", "label", "members", "files", "rank").collect()}
    assert over["1"][2:] == (2, 2, 1) and over["2"][2:] == (2, 1, 2) and " :: " in over["1"][1]
    row = spark.range(1).select(graph.summary(F.lit("A"), F.lit("class"), F.lit(2), F.lit(3)).alias("s"), graph.considered(F.lit("Bag"), F.lit("Box")).alias("a"), graph.considered(F.lit("int"), F.lit("Box")).alias("b"), graph.considered(F.lit("_12"), F.lit("Box")).alias("c")).first()
    assert row["s"] == "`A` is a class node that is moderately connected (5 total edges: 2 incoming, 3 outgoing)." and (row["a"], row["b"], row["c"]) == (True, False, False)


def test_edge_weights_of_files(spark):
    nodes = spark.createDataFrame([("a", "a"), ("b", "b")], "id string, file_path string")
    rows = [("a", "b", "references", 0.01), ("a", "b", "module_reference", 0.5), ("a", "b", "depends_on", 2.0), ("a", "b", "feature_affinity", 0.4), ("a", "b", "contains", 9.0)]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, weight double")
    assert graph.project_to_files(edges, nodes).first()["weight"] == 0.2 + 3.0 + 2.0 + 0.4


def test_merged_edges_keep_the_best_place(spark):
    rows = [("a", "b", "calls", "INFERRED", 1.0, "x", 1, 0.5), ("a", "b", "calls", "EXTRACTED", 2.0, "z", 9, 0.7), ("a", "b", "calls", "EXTRACTED", 1.0, "y", 3, 0.9), ("a", "a", "calls", "EXTRACTED", 1.0, "y", 3, 0.9)]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, confidence string, weight double, file string, line int, score double")
    assert [tuple(r) for r in graph.merge_edges(edges).collect()] == [("a", "b", "calls", 4.0, 3, "EXTRACTED", "y", 3, 0.9)]


def test_projects(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src" / "Login.cs").write_text("namespace G;\npublic class Login\n{\n    public void Open()\n    {\n    }\n}\n")
    (root / "src" / "Menu.cs").write_text("namespace G;\npublic class Menu\n{\n    Login login;\n}\n")
    known = Projects(spark, str(tmp_path / "projects"))
    assert known.projects().count() == 0
    made = known.index(str(root))
    assert (made["files"], made["symbols"], made["seq"]) == (2, 4, 1) and made["chunks"] == 2
    assert known.index(str(root))["seq"] == 2 and [r["root"] for r in known.projects().collect()] == [str(root)]
    tools = known.tools(str(root))
    assert [r["path"] for r in tools.call("deps", {"path": "src/Login.cs"})] == ["src/Menu.cs"]
    assert tools.call("search", {"query": "Login"})[0]["path"] == "src/Login.cs"
    assert {r["path"] for r in tools.call("search", {"query": "open the login menu"})} == {"src/Login.cs", "src/Menu.cs"}
    assert [r["line"] for r in tools.call("search", {"query": "login", "path_glob": "**/Menu.cs"})] == [4]
    assert tools.call("read", {"path": "zzz"}) == [] and tools.call("read", {"path": "src/Logn.cs"})[0]["did_you_mean"] == "src/Login.cs"
    text = tools.files.filter("path = 'src/Menu.cs'").select(lookups.defines(F.col("content"), "Menu").alias("a"), lookups.defines(F.col("content"), "Login").alias("b"), F.substring(F.sha2("content", 256), 1, 16).alias("h")).first()
    assert (text["a"], text["b"]) == (True, False)
    assert tools.call("read", {"path": "src/Menu.cs", "if_hash": text["h"]}) == [{"unchanged": True, "hash": text["h"]}]
    assert len(tools.call("read", {"path": "src/Menu.cs", "line_start": 2, "line_end": 3})) == 2
    over = tools.call("communities")
    assert len(over) == 1 and over[0]["members"] == 2 and len(tools.call("communities", {"community": over[0]["community"]})) == 2
    told = {r["path"]: r["text"] for r in lookups.file_texts(tools.files, tools.symbols).collect()}
    assert told["src/Login.cs"] == "src/Login.cs\nLogin src\nnamespace G\nclass Login\nmethod Open"


def test_scratch_needs_a_shared_folder(spark):
    from sparkloom.sources import scratch

    held = scratch.written(spark.range(3))
    assert held.count() == 3
    path = scratch._own(spark)
    assert path.startswith(scratch.folder(spark))

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://far:7077"})

    with pytest.raises(RuntimeError):
        scratch.folder(Far)


def test_atlas(spark, tmp_path):
    names = ["src/login/LoginView.cs", "src/login/LoginStore.cs", "src/bag/BagView.cs", "src/bag/BagStore.cs", "top.cs"]
    files = spark.createDataFrame([(p, "csharp", "G") for p in names], "path string, language string, namespace string")
    members = spark.createDataFrame([(p, p.split("/")[1] if "/" in p else "top") for p in names], "path string, module string")
    deps = spark.createDataFrame([(names[0], names[1]), (names[2], names[3]), (names[2], names[0])], "src string, dst string")
    symbols = spark.createDataFrame([(p, p.rpartition("/")[2][:-3], "class", 1) for p in names], "path string, name string, kind string, line_start long")
    made, points = atlas.build(files, deps, symbols, members)
    rows = {r["module"]: r for r in made.collect()}
    assert set(rows) == {"login", "bag"} and rows["bag"]["id"] == 0 and rows["bag"]["languages"][0]["language"] == "C#" and rows["login"]["label"].startswith("login")
    assert rows["bag"]["evidence"] == ["2 files and 2 indexed symbols", "dependency cohesion 0.50 from 1 internal and 1 boundary dependency edges", "semantic neighbor density 1.00"]
    assert [x["name"] for x in rows["bag"]["key_symbols"]] == ["BagView", "BagStore"]
    at = {r["path"]: r for r in points.collect()}
    assert len(at) == 4 and at[names[2]]["depends_on"] == sorted([at[names[3]]["id"], at[names[0]]["id"]]) and at[names[0]]["depended_by"] == [at[names[2]]["id"]]
    atlas.write(made, points, str(tmp_path / "atlas"))
    assert spark.read.json(str(tmp_path / "atlas" / "modules")).count() == 2 and spark.read.json(str(tmp_path / "atlas" / atlas.POINTS_FILE)).count() == 4
    found = spark.createDataFrame([("bag", names[2], 0.914, 1), ("bag", names[0], 0.5, 2)], "module string, path string, score double, rank long")
    assert {(r["path"], r["in_module"], r["density"]) for r in atlas.neighbours(found, members).collect()} == {(names[2], True, 0.5), (names[0], False, 0.5)}
    groups = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, community string")
    keys = spark.createDataFrame([("1", "login"), ("2", "login"), ("3", "bag")], "community string, token string")
    assert {r["id"]: r["community"] for r in atlas.by_feature(groups, keys).collect()} == {"a": "Login", "b": "Login", "c": "3"}
    assert tuple(atlas.graph_estimate(files, deps).first()) == (6, 8, 2)
