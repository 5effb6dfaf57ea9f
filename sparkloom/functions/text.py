"""Column functions over identifiers, lines and paths. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
# Fixed word lists.
STOPWORDS = "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split()
CODE_STOPWORDS = (
    "abstract and as async await base bool boolean break by case catch char class const continue default delegate do double else enum event extends extern "
    "false final finally float for foreach from get if implements import in int interface internal is let long namespace new null object or out override package "
    "params partial private protected public readonly ref return sealed set short static string struct switch this throw throws true try using var virtual void "
    "when where while yield"
).split()
LANGUAGES = {"cs": "csharp", "java": "java", "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "lua": "lua", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp"}
_BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[^0-9])"


def identifiers(text: Column) -> Column:
    """All ASCII identifiers, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def split_identifier(token: Column) -> Column:
    """Lower-case parts at underscores, or else at case and digit changes; two or more parts follow the whole token."""
    whole = F.lower(token)
    snake = F.filter(F.split(whole, "_"), lambda p: p != "")
    camel = F.transform(F.split(F.regexp_replace(token, _BOUNDARY, "\u0001"), "\u0001"), F.lower)
    parts = F.when(token.contains("_"), snake).otherwise(camel)
    # a plain word is its own only part: most tokens need no other test
    return F.when(token.rlike("^[A-Z]?[a-z]+$"), F.array(whole)).when(F.size(parts) >= 2, F.concat(F.array(whole), parts)).otherwise(F.array(whole))


def tokenize(text: Column) -> Column:
    """Parts of every identifier; order and repeats stay."""
    return F.flatten(F.transform(identifiers(text), split_identifier))


def is_index_token(token: Column) -> Column:
    """Longer than one byte and no keyword."""
    return (F.octet_length(token) > 1) & ~token.isin(*CODE_STOPWORDS)


def has_whole_word(text: Column, word: str) -> Column:
    quoted = word.replace("\\E", "\\E\\\\E\\Q")
    return text.rlike(rf"(?<![A-Za-z0-9_])\Q{quoted}\E(?![A-Za-z0-9_])")


def previous_identifier(text: Column) -> Column:
    """The last identifier run; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1), F.lit(""))


def lines_of(content: Column) -> Column:
    """Lines without their ends; a text's last line end starts no further line."""
    parts = F.split(content, "\r?\n")
    last = F.element_at(parts, -1) == ""
    return F.when(content.isNull() | (content == ""), F.array().cast("array<string>")).when(last, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_comment_or_blank(line: Column) -> Column:
    return line.rlike(r"^\s*$|^\s*(//|--|/\*|\*)")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^(?:\./)+", ""), r"\\", "/")


def under(path: Column, prefix: str) -> Column:
    """The prefix itself or something below it; the empty prefix holds everything."""
    clean = prefix.replace("\\", "/").removeprefix("./").strip("/")
    return F.lit(True) if not clean else (path == clean) | path.startswith(f"{clean}/")


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def language_of(path: Column) -> Column:
    """Language by extension; unknown for all others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), ext), F.lit("unknown"))


def path_penalty(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.contains("/test") | low.contains("tests/") | low.endswith("test.cs") | low.endswith("test.java"), 0.75)
        .when(low.contains("/examples/") | low.contains("/samples/"), 0.85)
        .when(low.contains("/compat/") | low.contains("/legacy/"), 0.9)
        .otherwise(1.0)
    )


def stem_matches(file_stem: Column, name: str) -> Column:
    """Equal, or equal without underscores or without trailing s (lower-cased)."""
    low, want = F.lower(file_stem), name.lower()
    return (low == want) | (F.replace(low, F.lit("_"), F.lit("")) == want) | (F.regexp_replace(low, "s+$", "") == want.rstrip("s"))


def prefix_overlap(a: Column, b: Column) -> Column:
    """Equal, or the shorter, of at least three bytes, begins the longer."""
    short, long_ = F.when(F.octet_length(a) <= F.octet_length(b), a).otherwise(b), F.when(F.octet_length(a) <= F.octet_length(b), b).otherwise(a)
    return (a == b) | ((F.octet_length(short) >= 3) & long_.startswith(short))


def path_root(path: Column, depth: int = 5) -> Column:
    """The first directories of a path, `depth` at most; empty for top-level files."""
    dirs = F.split(path, "/")
    n = F.least(F.size(dirs) - 1, F.lit(depth))
    return F.when(n > 0, F.array_join(F.slice(dirs, F.lit(1), F.greatest(n, F.lit(1))), "/")).otherwise("")


def qualified_name(text: Column) -> Column:
    """Dots for double colons, trimmed parts, without `global`."""
    parts = F.split(F.regexp_replace(text, "::", "."), r"\.")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & (p != "global")), ".")


def fingerprint(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cypher_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_name(text: Column, upper: bool = False) -> Column:
    """Letters, digits and underscores only, in front of a letter; labels keep case, relations are upper-case."""
    clean = F.regexp_replace(F.upper(text) if upper else text, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("N_"), clean))


def fuzzy_score(path: Column, query: str) -> Column:
    """Substring 100, compact substring 80, each plus the share of its length; else a greedy subsequence; else null.

    A subsequence gains 1 and half its streak a character, less a hundredth of each skipped character.
    """
    low, want = F.lower(path), query.lower()
    if not want:
        return F.lit(None).cast("double")
    tight, tight_want = compact(low), "".join(c for c in want if c.isascii() and c.isalnum())
    size = lambda c: F.greatest(F.octet_length(c), F.lit(1)).cast("double")
    out = F.when(low.contains(want), 100.0 + len(want.encode()) / size(low))
    if tight_want:
        out = out.when(tight.contains(tight_want), 80.0 + len(tight_want) / size(tight))
    looser = _subsequence(tight, tight_want) * 0.8 if tight_want else F.lit(None).cast("double")
    return out.otherwise(F.coalesce(_subsequence(low, want), looser))


def _subsequence(text: Column, query: str) -> Column:
    start = F.struct(F.lit(1).alias("at"), F.lit(0.0).alias("streak"), F.lit(0.0).alias("score"))

    def step(acc: Column, ch: Column) -> Column:
        found = F.when(acc["at"] > 0, F.position(ch, text, acc["at"]))
        gap = F.octet_length(F.substring(text, acc["at"], F.greatest(found - acc["at"], F.lit(0)))).cast("double")
        streak = F.when(gap == 0, acc["streak"] + 1).otherwise(1.0)
        hit = F.coalesce(found, F.lit(0)) > 0
        return F.struct(
            F.when(hit, found + 1).otherwise(0).alias("at"),
            F.when(hit, streak).otherwise(acc["streak"]).alias("streak"),
            F.when(hit, acc["score"] + 1.0 + streak * 0.5 - gap * 0.01).otherwise(acc["score"]).alias("score"),
        )

    return F.aggregate(F.array(*map(F.lit, query)), start, step, lambda acc: F.when(acc["at"] > 0, acc["score"]))
