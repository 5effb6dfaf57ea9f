"""Symbols, imports and namespaces of source files, without a grammar library: Python by its own parser, the brace languages and Lua by scanning.

The scanner blanks comments and strings, then reads declarations line by line with a stack of open bodies. It covers the
declarations that indexes need, not full grammars: declarations spread over lines are seen where their name is.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PARSED = "path string, language string, namespace string, imports array<string>, symbols array<struct<name:string,kind:string,line_start:bigint,line_end:bigint,detail:string>>"
# Fixed order of kinds for ties.
KINDS = ("namespace", "module", "class", "interface", "struct", "enum", "record", "trait", "impl", "type", "method", "constructor", "function", "property", "field", "constant", "static", "macro", "symbol")
_MOD = r"(?:\b(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|final|extern|unsafe|export|default|declare|const|inline|constexpr|explicit|pub(?:\([^)]*\))?|synchronized|native|strictfp|template\s*<[^>]*>)\s+)*"
_NAME = r"([A-Za-z_$][\w$]*)"
_TYPES = re.compile(rf"^\s*(?:\[[^\]]*\]\s*|@\w+(?:\([^)]*\))?\s+)*{_MOD}(class|interface|struct|enum(?:\s+class)?|record(?:\s+struct|\s+class)?|trait|@interface|delegate)\s+{_NAME}")
_CALLABLE = re.compile(rf"^\s*(?:\[[^\]]*\]\s*|@\w+(?:\([^)]*\))?\s+)*{_MOD}(?:[\w$<>\[\],.?:*&\s]+?[\s*&>\]])??(~?[A-Za-z_$][\w$:~]*)\s*(?:<[^>()]*>)?\s*\(")
_PROPERTY = re.compile(rf"^\s*{_MOD}[\w$<>\[\],.?]+\s+{_NAME}\s*(?:\{{\s*(?:get|set|init)\b|=>)")
_FIELD = re.compile(rf"^\s*{_MOD}[\w$<>\[\],.?]+\s+{_NAME}\s*(?:=[^=>]|;)")
_NOT_NAMES = set("if for while switch catch return new throw else do using lock foreach sizeof typeof delete await super this base function assert defined case in when where and or not elif yield import export package".split())
_RUST = [(re.compile(rf"^\s*{_MOD}(?:unsafe\s+|async\s+|const\s+|extern\s+\"?\w*\"?\s+)*{word}\s+{name}"), kind) for word, name, kind in (
    ("mod", r"(\w+)", "module"), ("struct", r"(\w+)", "struct"), ("enum", r"(\w+)", "enum"), ("trait", r"(\w+)", "trait"), ("fn", r"(\w+)", "function"),
    ("type", r"(\w+)", "type"), ("const", r"(?!fn\b)(\w+)\s*:", "constant"), ("static", r"(?:mut\s+)?(\w+)\s*:", "static"), ("union", r"(\w+)\s*\{", "symbol"))]
_RUST += [(re.compile(r"^\s*macro_rules!\s*(\w+)"), "macro"), (re.compile(r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^>]*>)?\s*(?:[\w:<>]+\s+for\s+)?([\w:]+)"), "impl")]
_TEXT = re.compile(r'/\*.*?\*/|//[^\n]*|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'|`(?:\\.|[^`\\])*`', re.S)
_LUA_TEXT = re.compile(r'--\[(=*)\[.*?\]\1\]|--[^\n]*|\[(=*)\[.*?\]\2\]|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


def _blanked(source: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _ends(blank: list[str]) -> list[int]:
    """For each line, the line on which the first body that opens on or after it closes."""
    out, stack = list(range(len(blank))), []
    for k, line in enumerate(blank):
        for ch in line:
            if ch == "{":
                stack.append(k)
            elif ch == "}" and stack:
                out[stack.pop()] = k
    return out


def rust_uses(body: str) -> list[str]:
    """A use tree's paths, with dots, without renames and braces."""
    body = re.sub(r"\s+as\s+\w+", "", re.sub(r"\s+", " ", body).strip())

    def expand(text: str, prefix: str) -> list[str]:
        out, depth, start = [], 0, 0
        for k, ch in enumerate(text + ","):
            depth += (ch == "{") - (ch == "}")
            if ch == "," and not depth:
                part, start = text[start:k].strip(), k + 1
                if "{" in part:
                    head, _, rest = part.partition("{")
                    out += expand(rest.rsplit("}", 1)[0], prefix + head.strip())
                elif part:
                    out.append(prefix if part == "self" else prefix + part)
        return out

    return [p.removesuffix("::").replace("::", ".") for p in expand(body, "")]


def _python(source: str) -> tuple[None, set[str], list[tuple]]:
    imports, found = set(), []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None, imports, found

    def walk(node: ast.AST, inside: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.Import):
                imports.update(a.name for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                imports.add("." * x.level + (x.module or ""))
            elif isinstance(x, ast.ClassDef):
                found.append((x.name, "class", x.lineno, x.end_lineno))
                walk(x, True)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                found.append((x.name, "function", x.lineno, x.end_lineno))
            else:
                walk(x, inside)

    walk(tree, False)
    return None, imports, found


def _lua(source: str) -> tuple[None, set[str], list[tuple]]:
    plain = re.sub(r"--\[(=*)\[.*?\]\1\]|--[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    imports = set(re.findall(r"""\brequire\s*\(?\s*["']([^"']+)["']""", plain))
    found, opened = [], []
    for k, line in enumerate(_blanked(source, _LUA_TEXT).split("\n"), 1):
        head = re.match(r"\s*(?:local\s+)?function\s+([\w.]+:)?([\w.]+)|\s*(?:local\s+)?([\w.]+)\s*=\s*function\b", line)
        own = None
        if head:
            name = (head[2] or head[3]).split(".")[-1]
            own = [name, "method" if head[1] else "function", k, k]
            found.append(own)
        for word in re.findall(r"\b(?:function|if|do|repeat|end|until)\b", line):
            if word in ("end", "until"):
                if opened and (last := opened.pop()):
                    last[3] = k
            else:
                opened.append(own if word == "function" else None)
                own = own if word != "function" else None
    return None, imports, [tuple(x) for x in found]


def _braces(source: str, language: str) -> tuple[str | None, set[str], list[tuple]]:
    blank = _blanked(source, _TEXT).split("\n")
    plain = re.sub(r"/\*.*?\*/|(?<!:)//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    ends, imports, found, namespace = _ends(blank), set(), [], None
    if language == "csharp":
        imports = {m for m in re.findall(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", plain, re.M)}
        if m := re.search(r"^\s*namespace\s+([\w.]+)", plain, re.M):
            namespace = m[1]
    elif language == "java":
        imports = {m for m in re.findall(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", plain, re.M)}
        if m := re.search(r"^\s*package\s+([\w.]+)\s*;", plain, re.M):
            namespace = m[1]
    elif language == "rust":
        imports = {p for body in re.findall(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", plain, re.M) for p in rust_uses(body)}
    elif language in ("javascript", "typescript"):
        imports = set(re.findall(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"']+)["']""", plain))
    elif language in ("c", "cpp"):
        imports = set(re.findall(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', plain, re.M))
    bodies: list[tuple[str, str, int]] = []  # kind, name, last line
    for k, line in enumerate(blank):
        while bodies and bodies[-1][2] < k:
            bodies.pop()
        inside = bodies[-1] if bodies else None
        if inside and inside[0] == "code":
            continue
        last = next((ends[j] for j in range(k, min(k + 3, len(blank))) if "{" in blank[j]), k) if "{" in line or not line.rstrip().endswith(";") else k
        hit = None
        if language == "rust":
            for pattern, kind in _RUST:
                if m := pattern.match(line):
                    hit = (m[1].split("::")[-1], kind)
                    break
        elif m := _TYPES.match(line):
            kind = m[1].split()[0].lstrip("@")
            hit = (m[2], kind if kind != "delegate" else "symbol")
        elif language in ("javascript", "typescript") and (m := re.match(rf"^\s*{_MOD}(?:function\s*\*?\s+{_NAME}|type\s+{_NAME}\s*(?:<[^>]*>)?\s*=|(?:let|var)?\s*{_NAME}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>))", line)):
            hit = (m[1] or m[2] or m[3], "type" if m[2] else "function")
        elif (m := _CALLABLE.match(line)) and m[1].split(":")[-1] not in _NOT_NAMES and (last > k or "{" in line or (inside and line.rstrip().endswith(";") and language not in ("javascript",))) and not re.match(r"^\s*(?:return|throw|new|else|await)\b", line):
            name = m[1].split("::")[-1]
            kind = ("constructor" if inside and name == inside[1] else "method") if inside and inside[0] in ("class", "interface", "struct", "record", "enum", "trait") else "function"
            hit = (name, kind)
        elif inside and inside[0] in ("class", "interface", "struct", "record") and (m := _PROPERTY.match(line) if language == "csharp" else None):
            hit = (m[1], "property")
        elif inside and inside[0] in ("class", "struct", "record") and language in ("csharp", "java") and (m := _FIELD.match(line)) and m[1] not in _NOT_NAMES:
            hit = (m[1], "field")
        if hit:
            found.append((*hit, k + 1, last + 1))
            if last > k:
                bodies.append(("code" if hit[1] in ("method", "constructor", "function", "property", "field", "macro") else hit[1], hit[0], last))
    return namespace, imports, found


def analyse(language: str, source: str) -> tuple[str | None, list[str], list[tuple]]:
    """namespace, sorted imports and (name, kind, first line, last line, detail) symbols; nothing for unknown languages."""
    if language == "python":
        namespace, imports, found = _python(source)
    elif language == "lua":
        namespace, imports, found = _lua(source)
    elif language in ("csharp", "java", "rust", "javascript", "typescript", "c", "cpp"):
        namespace, imports, found = _braces(source, language)
    else:
        return None, [], []
    rows = source.split("\n")
    found.sort(key=lambda s: (s[2], s[3], KINDS.index(s[1]) if s[1] in KINDS else len(KINDS), s[0]))
    out, seen = [], set()
    for name, kind, first, last in found:
        if (name, kind, first) not in seen:
            seen.add((name, kind, first))
            out.append([name, kind, first, last, next((r.strip() for r in rows[first - 1 : last] if r.strip()), "")])
    for own, after in zip(out, out[1:], strict=False):
        own[3] = max(own[2], min(own[3], after[2] - 1))
    return namespace, sorted(imports), [tuple(x) for x in out]


def parse_files(files: DataFrame) -> DataFrame:
    """files (path, language, content) as parsed rows. A file is one row, so nothing is exchanged."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, lang, *analyse(lang, text or "")) for p, lang, text in zip(batch["path"], batch["language"], batch["content"], strict=True)]
            yield pd.DataFrame(
                [(p, lang, ns, imports, [dict(zip(("name", "kind", "line_start", "line_end", "detail"), s, strict=True)) for s in found]) for p, lang, ns, imports, found in rows],
                columns=["path", "language", "namespace", "imports", "symbols"],
            )

    return files.select("path", "language", "content").mapInPandas(work, PARSED)
