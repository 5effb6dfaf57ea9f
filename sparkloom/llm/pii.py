"""Personal data: pattern seeds, then contexts that the seeds induce find more.

All of it is built-in functions. Seeds are the four base kinds. Every identifier-like token has a lexical pattern, the words
before it. Patterns and tokens form a bipartite graph; rounds of scoring pass confidence from seed tokens to patterns (the
share of a pattern's distinct tokens that are believed) and from accepted patterns to unseen tokens. Texts are scanned
once and never exchanged; graphs hold only tokens and contexts, pre-aggregated before each exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.tables import table, written

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Possessive quantifiers and anchors leave the matches as they are and keep the search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_@+.%-])(?=[A-Za-z_.%+-]*+[0-9@])[A-Za-z0-9+][A-Za-z0-9_.%+@-]*+(?:\x20?[(]?[0-9][0-9().-]*+)*+"
BYTE = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
#: The last two words, backwards, of a text that is read backwards, without space and brackets at its end.
BEFORE = r"^[\x20\x09-\x0D(]*+([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?)"


def find_all(text: str, pattern: str, gaps: bool = False) -> Column:
    """array<struct<s,e,t[,g]>>: bounds in code points and text of each leftmost match (g: the text since the match before).

    Bounds are running sums over the pieces between matches, in blocks of 256, so that many matches stay affordable.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"""
    transform(array(struct(split({text}, {quoted}, -1) as gs, regexp_extract_all({text}, {quoted}, 0) as ms)), p ->
      transform(array(zip_with(slice(p.gs, 1, size(p.ms)), p.ms, (g, t) ->
        named_struct('a', cast(char_length(g) as bigint), 'b', cast(char_length(t) as bigint), 't', t {", 'g', g" if gaps else ""}))), steps ->
      transform(array(transform(sequence(0, (greatest(size(steps), 1) - 1) div 256), k -> slice(steps, cast(k * 256 + 1 as int), 256))), blocks ->
        flatten(zip_with(blocks,
          slice(aggregate(transform(blocks, b -> aggregate(b, 0L, (acc, x) -> acc + x.a + x.b)), array(0L), (acc, n) -> concat(acc, array(element_at(acc, -1) + n))), 1, size(blocks)),
          (b, off) -> aggregate(b,
            named_struct('at', off, 'out', cast(array() as array<struct<s:bigint,e:bigint,t:string{",g:string" if gaps else ""}>>)),
            (acc, x) -> named_struct('at', acc.at + x.a + x.b, 'out', concat(acc.out, array(named_struct('s', acc.at + x.a, 'e', acc.at + x.a + x.b, 't', x.t{", 'g', x.g" if gaps else ""})))),
            acc -> acc.out))))[0])[0])[0]
    """)


def _empty(gaps: bool = False) -> Column:
    return F.expr(f"cast(array() as array<struct<s:bigint,e:bigint,t:string{',g:string' if gaps else ''}>>)")


def _if(test: Column, found: Column, gaps: bool = False) -> Column:
    return F.when(test, found).otherwise(_empty(gaps))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def base_spans(text: str = "text") -> Column:
    """array<struct<kind int, s, e>> of the base kinds, by kind as listed, then start."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    email = _if(t.contains("@"), find_all(text, EMAIL))
    ip = F.filter(_if(digit & t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), find_all(text, IP)), lambda x: F.forall(F.split(x["t"], r"\."), lambda p: p.rlike(f"^{BYTE}$")))
    card = F.filter(
        _if(digit & t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), find_all(text, CARD)),
        lambda x: F.char_length(_digits(x["t"])).between(13, 19) & F.call_function("luhn_check", _digits(x["t"])),
    )
    phone = F.filter(_if(t.contains("+"), find_all(text, PHONE)), lambda x: F.char_length(_digits(x["t"])).between(9, 15))
    cast = lambda k, spans: F.transform(spans, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return F.concat(*(cast(k, spans) for k, spans in enumerate((email, ip, card, phone))))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, accept: float = 0.7, support: float = 3.0) -> DataFrame:
    """One row a document: doc_id, base_spans and spans (arrays of kind number, start, end).

    A pattern is accepted for a kind if at least `support` distinct tokens and the share `accept` of its tokens are believed
    to be of that kind; it then passes belief, times its share, on to its other tokens. Found tokens never overlap a base
    span; they have at least six digits, or an at sign for emails. Null and empty texts have no spans; repeated rows are
    independent.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tokens = _if(F.col("text").rlike("[0-9@]"), find_all("text", TOKEN, gaps=True), gaps=True)
    trimmed = lambda x: F.regexp_replace(x["t"], "[^A-Za-z0-9]+$", "")
    # read backwards and anchored, a gap of any length costs only what its last two words cost
    words = lambda x: F.lower(F.reverse(F.regexp_extract(F.reverse(x["g"]), BEFORE, 1)))
    flat = src.select(
        "doc_id",
        base_spans().alias("base_spans"),
        F.transform(
            tokens,
            lambda x: F.struct(
                x["s"].alias("s"),
                (x["s"] + F.char_length(trimmed(x))).alias("e"),
                F.lower(trimmed(x)).alias("token"),
                F.regexp_replace(words(x), r"[\x20\x09-\x0D]+", " ").alias("pattern"),
            ),
        ).alias("tokens"),
    )
    flat = written(flat.withColumn("row", F.monotonically_increasing_id()))
    seen = flat.filter(F.size("tokens") > 0).select("row", "base_spans", F.explode("tokens").alias("x"))
    overlap = F.filter("base_spans", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s")))
    seen = seen.select(
        "row", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.token").alias("token"), F.col("x.pattern").alias("pattern"),
        F.when(F.size(overlap) > 0, overlap[0]["kind"]).alias("seed"),
    )
    seen = written(seen.filter("token <> '' AND pattern <> ''"))
    edges = written(seen.groupBy("pattern", "token").agg(F.count("*").alias("n")))
    belief = written(seen.filter("seed IS NOT NULL").groupBy("token", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("belief")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("tokens"))
    digits = F.char_length(_digits(F.col("token")))
    fits = F.when(F.col("kind") == 0, F.col("token").contains("@")).otherwise(digits >= 6)
    patterns = None
    for _ in range(rounds):
        scored = edges.join(belief, "token").groupBy("pattern", "kind").agg(F.sum("belief").alias("held"))
        patterns = written(
            scored.join(sizes, "pattern").withColumn("score", F.col("held") / F.col("tokens"))
            .filter((F.col("score") >= accept) & (F.col("held") >= support)).select("pattern", "kind", "score")
        )
        spread = edges.join(patterns, "pattern").filter(fits).select("token", "kind", F.col("score").alias("belief"))
        belief = written(belief.unionByName(spread).groupBy("token", "kind").agg(F.max("belief").alias("belief")))
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    found = (
        seen.filter("seed IS NULL").join(best, "pattern").filter(fits)
        .groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    )
    none = F.expr("cast(array() as array<struct<kind:int,s:bigint,e:bigint>>)")
    return flat.join(found, "row", "left").select(
        "doc_id", "base_spans", F.array_sort(F.concat("base_spans", F.coalesce("more", none))).alias("spans")
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"),
    )
