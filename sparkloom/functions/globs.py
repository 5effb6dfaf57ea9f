"""Glob patterns and ignore files as regular expressions for rlike."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    """An anchored Java regex. A pattern without a slash matches at any depth; * crosses slashes; bad patterns raise ValueError."""
    text = re.sub(r"^(?:\./)+", "", pattern).replace("\\", "/")
    if "/" not in text:
        text = f"**/{text}"
    out, at, depth = [], 0, 0
    while at < len(text):
        ch = text[at]
        if text.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
            continue
        if ch == "*":
            while at + 1 < len(text) and text[at + 1] == "*":
                at += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = text.find("]", at + 2)
            if end < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            body = text[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]")
            at = end
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(ch) if not ch.isalnum() and ch not in "_/" else ch)
        at += 1
    if depth:
        raise ValueError(f"unclosed alternatives in {pattern!r}")
    return f"^(?s:{''.join(out)})$"


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regex over paths relative to the file's folder, ignore) of each rule of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        rule = re.sub(r"(?<!\\)\s+$", "", line)
        if not rule or rule.startswith("#"):
            continue
        drop = not rule.startswith("!")
        rule = rule.removeprefix("!").removeprefix("\\")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        rooted = "/" in rule
        body = glob_to_segments(rule.lstrip("/"))
        out.append((f"^{'' if rooted else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", drop))
    return out


def glob_to_segments(pattern: str) -> str:
    """As ignore files read it: * and ? stay within a path segment."""
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out.append("/.*")
            at += 3
        else:
            ch = pattern[at]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch)))
            at += 1
    return "".join(out)


def ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last rule that matches decides."""
    verdict = False
    for regex, drop in rules:
        if re.match(regex, path):
            verdict = drop
    return verdict
