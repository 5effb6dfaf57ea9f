import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import code, globs
from sparkloom.functions import text as X


def test_split_identifier(spark):
    cases = {"parseHTTPServer2Go": "parsehttpserver2go parse http server 2 go", "snake_case_": "snake_case_ snake case", "plain": "plain", "_": "_", "AB": "ab", "a1B": "a1b a 1 b"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.array_join(X.split_identifier(F.col("t")), " ").alias("p")).collect()
    assert {r["t"]: r["p"] for r in rows} == cases


def test_lines_fuzzy_and_paths(spark):
    row = spark.range(1).select(
        X.lines_of(F.lit("a\r\nb\n")).alias("lines"), X.lines_of(F.lit("")).alias("none"), X.lines_of(F.lit("\n\n")).alias("blank"),
        F.round(X.fuzzy_score(F.lit("src/Main.java"), "main"), 6).alias("sub"), F.round(X.fuzzy_score(F.lit("src/ma-in.java"), "main"), 6).alias("tight"),
        F.round(X.fuzzy_score(F.lit("abc"), "ac"), 6).alias("seq"), X.fuzzy_score(F.lit("abc"), "cx").alias("miss"),
        X.path_root(F.lit("a/b/c.py")).alias("root"), X.stem(F.lit("a/b.c.py")).alias("stem"), X.qualified_name(F.lit("global::A . B")).alias("q"),
        X.language_of(F.lit("x/y.TSX")).alias("lang"), X.previous_identifier(F.lit("new Foo (")).alias("prev"), X.path_penalty(F.lit("a/tests/x")).alias("pen"),
    ).first()
    assert row["lines"] == ["a", "b"] and row["none"] == [] and row["blank"] == ["", ""]
    assert row["sub"] == round(100 + 4 / 13, 6) and row["tight"] == round(80 + 4 / 11, 6)
    assert row["seq"] == round(1.5 + 1 + 0.5 - 0.01, 6) and row["miss"] is None
    assert (row["root"], row["stem"], row["q"], row["lang"], row["prev"], row["pen"]) == ("a/b", "b.c", "A.B", "typescript", "Foo", 0.75)


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.py", "a/b/c.py", True), ("*.py", "c.py", True), ("src/**/x.rs", "src/x.rs", True), ("src/*.rs", "src/a/b.rs", True), ("src/{a,b}.c", "src/b.c", True), ("[ab].c", "d/c.c", False), ("?.c", "ab.c", False), ("./src/*", "src/q", True)],
)
def test_globs(pattern, path, hit):
    assert bool(re.match(globs.glob_to_regex(pattern), path)) == hit


def test_ignore_rules():
    rules = globs.ignore_rules("# c\n*.log\n!keep.log\nbuild/\n/top\n")
    assert [globs.ignored(p, rules) for p in ("a/x.log", "a/keep.log", "build/x", "a/build/y", "top", "a/top")] == [True, False, True, True, True, False]


def test_code_shapes():
    assert code.strip_for_callers('a "b // c" // d').rstrip() == "a"
    assert code.strip_for_dependencies('x = @"a\\"; Foo').rstrip().endswith("Foo")
    assert code.refers("Foo()", "Foo", None) and not code.refers("a.Foo()", "Foo", None) and code.refers("N.Foo()", "Foo", "N")
    shapes = {"new Foo()": True, "List<Foo> x": True, "Foo.bar": True, "Foo x": True, "Foo[] x": True, "Foo = 3": False, "x Foo;": False}
    assert {k: code.type_shaped(k, "Foo") for k in shapes} == shapes


@given(st.text(max_size=40))
def test_stripping_never_grows(line):
    assert len(code.strip_for_callers(line)) <= len(line) and len(code.strip_for_dependencies(line)) <= len(line)
