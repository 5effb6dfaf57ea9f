"""Small source trees that the registered queries parse, resolve and search: a folder a scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, language string, content string"
SOURCES = [
    ("cs/A/Gem.cs", "csharp", "namespace A.One;\npublic class Gem { }\n"),
    ("cs/B/Orb.cs", "csharp", "namespace B.Two;\npublic class Orb { }\n"),
    ("cs/C/Use.cs", "csharp", "namespace C;\npublic class Use {\n  A.One.Gem g;\n  B.Two.Orb o;\n  // Ring in a comment\n  string s = \"Ring\";\n}\n"),
    ("cs/D/Util.cs", "csharp", "namespace D;\npublic static class Util { }\n"),
    ("cs/D/XAttribute.cs", "csharp", "namespace D;\npublic class XAttribute { }\n"),
    ("cs/D/Things.cs", "csharp", "namespace D;\npublic class Ring\n{\n    public int Size { get; set; }\n    public void Turn(int n)\n    {\n        Size += n;\n    }\n}\n"),
    ("cs/E/Mark.cs", "csharp", "using D;\nusing G = A.One.Gem;\nusing static D.Util;\n[X]\npublic class Mark {\n  Ring r = new Ring();\n  int x = other.Ring;\n}\n"),
    ("java/p/Jade.java", "java", "package p;\npublic class Jade {\n    private int facets;\n    public int cut(int n) {\n        return facets - n;\n    }\n}\n"),
    ("java/p/Ore.java", "java", "package p;\npublic class Ore { }\n"),
    ("java/q/Use.java", "java", "package q;\nimport p.Jade;\npublic class Use {\n  Jade g;\n  p.Ore o;\n}\n"),
    ("java/r/All.java", "java", "package r;\nimport p.*;\npublic class All {\n  Jade g;\n}\n"),
    ("rs/src/lib.rs", "rust", "pub mod m;\n"),
    ("rs/src/m.rs", "rust", "pub struct A1;\npub struct B1;\n"),
    ("rs/src/use_it.rs", "rust", "use crate::m::{A1, B1};\nfn f() {}\n"),
    ("lua/scripts/game/player.lua", "lua", "local M = {}\nfunction M:jump(h)\n  return h\nend\nreturn M\n"),
    ("lua/main.lua", "lua", 'local p = require("game.player")\nlocal function go()\n  p:jump(2)\nend\n'),
]
# (path, name, kind, first line, last line) that overlap and repeat.
RANGES = [("a", "outer", "class", 1, 40), ("a", "one", "method", 5, 12), ("a", "one", "method", 5, 30), ("a", "two", "method", 10, 14), ("a", "last", "field", 20, 20), ("b", "x", "class", 3, 9), ("b", "y", "class", 3, 4)]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SCHEMA)


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "path string, name string, kind string, line_start bigint, line_end bigint")
