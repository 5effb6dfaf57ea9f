"""Character state machines over lines of code, as Arrow-batched UDFs: used only on lines that joins have already selected."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE_KINDS = ("class", "interface", "struct", "enum", "record")
_BEFORE_TYPE = {"new", "typeof", "nameof", "is", "as"}


def _blank(line: str, keep_escapes: bool) -> str:
    """Strings become spaces, a line comment ends the line. keep_escapes: a backslash protects the next character."""
    out, quote, skip = [], "", False
    for k, ch in enumerate(line):
        if quote:
            out.append(" ")
            if skip:
                skip = False
            elif ch == "\\" and keep_escapes:
                skip = True
            elif ch == quote:
                quote = ""
        elif line.startswith("//", k):
            break
        elif ch in "\"'":
            quote = ch
            out.append(" ")
        else:
            out.append(ch)
    return "".join(out)


def strip_for_callers(line: str) -> str:
    return _blank(line, True)


_DEPENDENCY_TEXT = re.compile(r"""@"(?:[^"]|"")*(?:"|$)|"[^"]*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|//.*""")


def strip_for_dependencies(line: str) -> str:
    """As above, with verbatim strings; plain strings end at the next quote whatever precedes it."""
    return _DEPENDENCY_TEXT.sub(lambda m: "" if m[0].startswith("//") else " " * len(m[0]), line)


def _words(code: str, name: str) -> list[int]:
    found, at = [], code.find(name) if name else -1
    while at >= 0:
        end = at + len(name)
        if not re.match(r"[A-Za-z0-9_]", code[at - 1 : at] or " ") and not re.match(r"[A-Za-z0-9_]", code[end : end + 1] or " "):
            found.append(at)
        at = code.find(name, end)
    return found


def refers(code: str, name: str, namespace: str | None) -> bool:
    """Some whole word that no dot precedes, unless the target's own namespace does."""
    for at in _words(code, name):
        before = code[:at].rstrip()
        if not before.endswith(".") or (namespace and before.endswith(f"{namespace}.")):
            return True
    return False


def type_shaped(code: str, name: str) -> bool:
    """Some whole word that stands where types stand."""
    for at in _words(code, name):
        before, after = code[:at].rstrip(), code[at + len(name) :].lstrip()
        word = re.search(r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", before)
        if (word and word[1] in _BEFORE_TYPE) or before.endswith((":", "<", ",", "(")) or after.startswith("."):
            return True
        after = after.removeprefix("[]").removeprefix("?").lstrip()
        if re.match(r"[@_A-Za-z]", after):
            return True
    return False


@F.pandas_udf(T.StringType())
def strip_callers_udf(line: pd.Series) -> pd.Series:
    return line.fillna("").map(strip_for_callers)


@F.pandas_udf(T.StringType())
def strip_dependencies_udf(line: pd.Series) -> pd.Series:
    return line.fillna("").map(strip_for_dependencies)


@F.pandas_udf(T.BooleanType())
def is_reference_udf(code: pd.Series, name: pd.Series, namespace: pd.Series, kind: pd.Series) -> pd.Series:
    rows = zip(code, name, namespace, kind, strict=True)
    return pd.Series([refers(c, n, s) and (k not in TYPE_KINDS or type_shaped(c, n)) for c, n, s, k in rows], dtype=bool)
