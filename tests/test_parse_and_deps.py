import pytest

from sparkloom.operators import callers, chunks, deps, index
from sparkloom.operators.parse import analyse, parse_files, rust_uses
from sparkloom.sources import scan
from sparkloom.sources import views as V

SOURCES = {
    "csharp": ("using System.Text;\nnamespace Shop.Core;\npublic class Basket\n{\n    public int Size { get; set; }\n    public void Add(string item)\n    {\n        Size++;\n    }\n}\n", "Shop.Core", {"System.Text"}, {("Basket", "class"), ("Size", "property"), ("Add", "method")}),
    "java": ("package shop.core;\nimport java.util.List;\npublic class Basket {\n    private List<String> items;\n    public void add(String item) {\n        items.add(item);\n    }\n}\n", "shop.core", {"java.util.List"}, {("Basket", "class"), ("items", "field"), ("add", "method")}),
    "rust": ("use crate::a::{B, c::D as E};\nuse std::fmt;\nmod inner {\n    pub struct S { x: u32 }\n    pub enum K { A }\n    pub trait T { }\n    impl S { }\n    pub fn go() { }\n    type Q = u32;\n    const N: u32 = 1;\n    static M: u32 = 2;\n}\nmacro_rules! mm { () => {} }\n", None, {"crate.a.B", "crate.a.c.D", "std.fmt"}, {("inner", "module"), ("S", "struct"), ("K", "enum"), ("T", "trait"), ("S", "impl"), ("go", "function"), ("Q", "type"), ("N", "constant"), ("M", "static"), ("mm", "macro")}),
    "python": ("import a, b as c\nfrom x.y import z\nclass K:\n    def go(self):\n        pass\n", None, {"a", "b", "x.y"}, {("K", "class"), ("go", "function")}),
    "lua": ('local a = require("game.a")\nlocal b = require "game.b"\nfunction M:attack(x)\n  if x then return end\nend\nlocal function go() end\nrun = function() end\nM.stop = function() end\n', None, {"game.a", "game.b"}, {("attack", "method"), ("go", "function"), ("run", "function"), ("stop", "function")}),
    "typescript": ('import { A } from "./a";\nexport interface Shape {\n  area(): number;\n}\nexport class Sq implements Shape {\n  area(): number {\n    return 1;\n  }\n}\n', None, {"./a"}, {("Shape", "interface"), ("Sq", "class"), ("area", "method")}),
    "cpp": ("#include <vector>\nclass Box {\npublic:\n  int n;\n};\nint main() {\n  return 0;\n}\n", None, {"vector"}, {("Box", "class"), ("main", "function")}),
}


@pytest.mark.parametrize("language", SOURCES)
def test_languages(language):
    text, namespace, imports, symbols = SOURCES[language]
    space, found, rows = analyse(language, text)
    assert space == namespace and imports <= set(found)
    assert symbols <= {(r[0], r[1]) for r in rows}
    assert all(a[3] < b[2] or a[2] == b[2] for a, b in zip(rows, rows[1:], strict=False))


def test_odd_sources():
    assert analyse("python", "def (") == (None, [], [])
    assert analyse("klingon", "x") == (None, [], [])
    assert all(analyse(lang, "") == (None, [], []) for lang in SOURCES)
    assert rust_uses("a::{self, b::{C, D}}") == ["a", "a.b.C", "a.b.D"]


DEPS = {
    "csharp qualified": ([("A/Gem.cs", "csharp", "namespace A.One;\npublic class Gem { }\n"), ("B/Orb.cs", "csharp", "namespace B.Two;\npublic class Orb { }\n"), ("C/Use.cs", "csharp", "namespace C;\npublic class Use {\n  A.One.Gem g;\n  B.Two.Orb o;\n}\n")], {("C/Use.cs", "A/Gem.cs"), ("C/Use.cs", "B/Orb.cs")}),
    "csharp alias, static, attribute": ([("Gem.cs", "csharp", "namespace A;\npublic class Gem { }\n"), ("Util.cs", "csharp", "namespace A;\npublic static class Util { }\n"), ("XAttribute.cs", "csharp", "namespace A;\npublic class XAttribute { }\n"), ("Use.cs", "csharp", "using A;\nusing G = A.Gem;\nusing static A.Util;\n[X]\npublic class Use { }\n")], {("Use.cs", "Gem.cs"), ("Use.cs", "Util.cs"), ("Use.cs", "XAttribute.cs")}),
    "csharp other stem": ([("Things.cs", "csharp", "namespace A;\npublic class Lonely { }\n"), ("Use.cs", "csharp", "using A;\npublic class Use {\n  Lonely x;\n}\n")], {("Use.cs", "Things.cs")}),
    "java import and qualified": ([("p/Gem.java", "java", "package p;\npublic class Gem { }\n"), ("p/Orb.java", "java", "package p;\npublic class Orb { }\n"), ("q/Use.java", "java", "package q;\nimport p.Gem;\npublic class Use {\n  Gem g;\n  p.Orb o;\n}\n")], {("q/Use.java", "p/Gem.java"), ("q/Use.java", "p/Orb.java")}),
    "java wildcard": ([("p/Gem.java", "java", "package p;\npublic class Gem { }\n"), ("q/Use.java", "java", "package q;\nimport p.*;\npublic class Use {\n  Gem g;\n}\n")], {("q/Use.java", "p/Gem.java")}),
    "rust": ([("src/m.rs", "rust", "pub struct A;\npub struct B;\n"), ("src/use_it.rs", "rust", "use crate::m::{A, B};\nfn f() {}\n"), ("src/lib.rs", "rust", "pub mod m;\n")], {("src/use_it.rs", "src/m.rs"), ("src/lib.rs", "src/m.rs")}),
    "lua": ([("scripts/game/player.lua", "lua", "local M = {}\nreturn M\n"), ("main.lua", "lua", 'local p = require("game.player")\n')], {("main.lua", "scripts/game/player.lua")}),
}


def test_dependencies(spark):
    # all cases at once, each below its own folder's names
    for name, (rows, expected) in DEPS.items():
        files = spark.createDataFrame(rows, "path string, language string, content string")
        got = {(r["src"], r["dst"]) for r in deps.resolve(files, parse_files(files)).collect()}
        assert expected <= got, name
        assert all(a != b for a, b in got)


def test_callers(spark):
    rows = [("Gem.cs", "csharp", "namespace A;\npublic class Gem { }\n"), ("Use.cs", "csharp", 'using A;\npublic class Use {\n  Gem g = new Gem();\n  // Gem in a comment\n  string s = "Gem";\n  int x = other.Gem;\n}\n'), ("Far.cs", "csharp", "namespace B;\npublic class Far { Gem g; }\n")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    parsed, lines = parse_files(files), V.lines(files)
    target = spark.createDataFrame([("Gem", "Gem.cs", "A", "class")], "name string, path string, namespace string, kind string")
    got = callers.callers(index.word_hits(lines), lines, parsed, target)
    assert [(r["path"], r["line"]) for r in got.collect()] == [("Use.cs", 3)]


def test_chunks_cover_all_lines():
    lines = ["x" * 100] * 300
    cut = chunks.cut_chunks(lines, [(10, 40), (40, 90), (200, 260)])
    assert [n for a, b in cut for n in range(a, b + 1)] == list(range(1, 301))
    assert all(sum(101 for _ in range(a, b + 1)) <= chunks.TARGET + 101 for a, b in cut)
    assert chunks.cut_chunks([" ", ""], []) == []


def test_scan_scope(spark):
    listing = [("src/a.cs",), ("src/Editor/b.cs",), ("Library/Cache/c.cs",), ("Library/Other/d.cs",), ("tools/e.py",), (".git/f.cs",), ("src/g.txt",), ("logs/h.cs",)]
    df = spark.createDataFrame(listing, "path string")
    paths = lambda o, ignore="": {r["path"] for r in scan.in_scope(df, o, ignore).collect()}
    assert paths(scan.ScanOptions()) == {"src/a.cs", "src/Editor/b.cs", "Library/Cache/c.cs", "Library/Other/d.cs", "tools/e.py", "logs/h.cs"}
    assert paths(scan.ScanOptions(root_paths=("src",))) == {"src/a.cs", "src/Editor/b.cs"}
    assert paths(scan.ScanOptions(root_paths=("src",), exclude_paths=("**/Editor/**",))) == {"src/a.cs"}
    assert paths(scan.ScanOptions(skip_dirs=("library",), include_paths=("Library/Cache",), root_paths=("src",))) == {"src/a.cs", "src/Editor/b.cs", "Library/Cache/c.cs"}
    assert "logs/h.cs" not in paths(scan.ScanOptions(), "logs/\n")
    assert scan.load_options('[scan]\nextensions = "CS, .py"\nroots = ["a\\\\b"]\n').root_paths == ("a/b",)


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\n\nx = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"x")
    (tmp_path / "src/c.py").write_bytes(b"a\x00b")
    rows = {r["path"]: r for r in scan.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py"} and rows["src/a.py"]["line_count"] == 3 and rows["src/a.py"]["language"] == "python"
