"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, then exact confirmation on full shingle sets.

A signature has POSITIONS values of 16 bits. Two signatures that differ in at most radius(chunks) positions must, by pigeonhole,
differ in at most one position of some chunk; so each chunk yields a key for every position that is left out, and every pair
within the radius shares a key. chunks_for() takes as many chunks as the link threshold needs: at 0.85 a pair's distance averages
0.15 * POSITIONS, about four standard deviations below the radius of CHUNKS chunks; lower thresholds take more chunks.

No group of copies is expanded into pairs. Equal sets become one representative. Each representative is first compared with
one hub, the document that shares most keys, of the groups it is in; connected components of those links settle nearly all
groups. Where a key still holds several components, documents outside its main one meet that one's most central member. Pairs are
formed only across what components are left, within the radius, where shingles that others share make a link possible at all; so no
link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.tables import bitmap, maybe_in, table, written
from sparkloom.llm.words import mix, slices

WIDTH = 5
POSITIONS, CHUNKS = 48, 9
#: How likely a pair at exactly the threshold may lie beyond the radius.
MISS = 1.2e-4
#: Every other lane of 16 bits, and the bits to which sums of such lanes carry.
_LANES, _CARRY = 0x0000FFFF0000FFFF, 0x0001000000010000
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 64, POSITIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, POSITIONS, dtype=np.uint64)


def radius(chunks: int) -> int:
    """Chunks tolerate one error each, so pigeonhole covers up to 2 * chunks - 1."""
    return 2 * chunks - 1


RADIUS = radius(CHUNKS)


def chunks_for(percent: int) -> int:
    """The fewest chunks, CHUNKS at least, with which a pair at the threshold is missed with a probability of MISS at most (binomial tail)."""
    p = 1 - percent / 100
    chunks = CHUNKS
    while sum(math.comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in range(radius(chunks) + 1, POSITIONS + 1)) > MISS:
        chunks += 1
    return chunks


def chunk_starts(chunks: int) -> list[int]:
    return [c * POSITIONS // chunks for c in range(chunks)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of the least hash of each non-empty set, under each of POSITIONS hash functions."""
    out = np.empty((len(sets), POSITIONS), dtype=np.uint16)
    if sets:
        every = np.concatenate(sets)
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for k in range(POSITIONS):
            out[:, k] = mix(np.minimum.reduceat(every * _A[k] + _B[k], first)) & np.uint64(0xFFFF)
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and its signature (12 longs of four positions)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.ArrayType(T.LongType(), False))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in slices(batch["text"]):
                sets = words.shingles(WIDTH)
                full = [k for k, s in enumerate(sets) if len(s)]
                sigs: list[np.ndarray | None] = [None] * len(sets)
                for k, row in zip(full, signatures([sets[k] for k in full]).view(np.int64), strict=True):
                    sigs[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(sigs, pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def shingle_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """digest of the set and its sorted distinct shingle hashes, of every text that has any."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType(), False))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in slices(batch["text"]):
                sets = [s for s in words.shingles(WIDTH) if len(s)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=schema.names)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def chunk_keys(chunks: int = CHUNKS) -> list[Column]:
    """A key for each chunk and position of it that is left out."""
    value = [F.shiftright(F.get("sig", F.lit(k // 4)), 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)) for k in range(POSITIONS)]
    keys, starts = [], chunk_starts(chunks)
    for first, end in zip(starts, [*starts[1:], POSITIONS], strict=True):
        chunk = range(first, end)
        keys += [F.xxhash64(F.lit(out), *(value[k] for k in chunk if k != out)) for out in chunk]
    return keys


def distance(a: str, b: str) -> Column:
    """Differing positions of two signatures: lanes of 16 bits that are not zero in their exclusive or."""

    def lanes(k: int) -> str:
        x = f"(get({a}, {k}) ^ get({b}, {k}))"
        return " + ".join(f"bit_count((({y} & {_LANES}L) + {_LANES}L) & {_CARRY}L)" for y in (x, f"shiftrightunsigned({x}, 16)"))

    return F.expr(" + ".join(lanes(k) for k in range(POSITIONS // 4)))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node reachable) of every node in links, by alternating large-star and small-star steps.

    Steps exchange narrow rows only. Minima are written before they are joined back, so that a join's sides are plain
    exchanges, which adaptive execution splits where a node has many links. Stops when a step changes nothing.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        kept = least.filter("m < u").select("u", F.col("m").alias("v"))
        large = large.unionByName(kept).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    held = pairs.join(left, "a").join(right, "b").withColumn("both", shared)
    return held.filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def with_nodes(every: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """every with a column node, and (doc_id, digest, node) of ids that stand on several texts, or None if there are none.

    A node stands for one text of one id. It is the id itself, except for further texts of an id, whose nodes are numbers above
    all ids; so a component's least node is always an id, as long as an id's nodes are linked.
    """
    several = every.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last")
    several = written(several.select("doc_id", "first"))
    count = several.count()
    if not count:
        return every.withColumn("node", F.col("doc_id")), None
    above = every.agg(F.max("doc_id")).first()[0] + 1
    marks = bitmap(several, "doc_id", count)
    texts = maybe_in(every, F.col("doc_id"), marks).filter("digest IS NOT NULL").select("doc_id", "digest").distinct().join(several, "doc_id")
    texts = written(texts.withColumn("number", F.monotonically_increasing_id()))
    texts = texts.select("doc_id", "digest", F.when(F.col("digest") == F.col("first"), F.col("doc_id")).otherwise(F.col("number") + F.lit(above)).alias("node"))
    found = every.join(texts.withColumnRenamed("node", "own"), ["doc_id", "digest"], "left")
    return found.withColumn("node", F.coalesce("own", "doc_id")).drop("own"), texts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents without words have no shingles and link with nothing; null text counts as such. Rows that repeat an id are one
    document: each has the n_shingles of its own text, all texts link, and the id's component holds what any of them links with. A null id is
    no document and is left out of links.
    """
    every = written(sketch(docs, id_col, text_col))
    every, several = with_nodes(every)
    classes = written(every.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("n_shingles", "sig", "doc_id"), "node").alias("of"), F.min("node").alias("rep")))
    tasks = 3 * docs.sparkSession.sparkContext.defaultParallelism
    reps = classes.select("rep", "of.n_shingles", "of.sig")
    # keys are many times the rows they come from: small files of classes must not mean few tasks
    keyed = reps.repartition(tasks).select("rep", F.posexplode(F.array(*chunk_keys(chunks_for(percent)))).alias("slot", "key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    marks = bitmap(shared, "key", shared.count())
    members = written(maybe_in(keyed, F.col("key"), marks).join(shared, "key"))
    # the hub of a key shares most keys with others; each document meets the best hub of its keys
    degree = members.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = written(members.join(degree, "rep"))
    order = F.struct("degree", -F.col("rep"))
    hubs = written(ranked.groupBy("key").agg(F.max_by("rep", order).alias("hub"), F.max(order).alias("rank")))
    meets = ranked.join(hubs, "key").filter("rep <> hub").groupBy("rep").agg(F.max_by("hub", "rank").alias("hub"))
    involved = written(classes.select("digest", "rep", "of.doc_id").join(ranked.select("rep").distinct(), "rep", "left_semi"))
    wanted = bitmap(involved, "doc_id", involved.count())
    some = maybe_in(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("doc_id"), wanted)
    sets = written(shingle_sets(some, "text").join(involved.select("digest", "rep"), "digest").dropDuplicates(["rep"]).select("rep", "shingles"))
    links = confirmed(meets.select(F.col("rep").alias("a"), F.col("hub").alias("b")), sets, percent)
    if several is not None:
        of_id = several.join(classes.select("digest", "rep"), "digest").groupBy("doc_id").agg(F.min("rep").alias("b"))
        own = several.join(classes.select("digest", "rep"), "digest").join(of_id, "doc_id").filter("rep <> b")
        links = links.unionByName(own.select(F.col("rep").alias("a"), "b").distinct())
    links = written(links)
    members = ranked.select("key", "slot", "rep")
    held = open_members(members, components(links))
    able = written(linkable(held, reps, sets, percent))
    links = written(links.unionByName(confirmed(central_pairs(held, able), sets, percent)))
    held = open_members(held.select("key", "slot", "rep"), components(links))
    links = links.unionByName(confirmed(crossing_pairs(held, able, percent), sets, percent))
    final = components(links).select(F.col("node").alias("rep"), "root")
    of_class = classes.select("digest", "rep").join(final, "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    if several is not None:
        # a class of further texts alone has no id for its least node, but its component has
        least = several.join(of_class, "digest").groupBy("root").agg(F.min("doc_id").alias("least"))
        of_class = of_class.join(least, "root", "left").select("digest", F.least("root", "least").alias("root"))
    out = every.select("doc_id", "n_shingles", "digest").join(written(of_class), "digest", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, slot, rep, root and main (the component with most members) for keys that hold several components."""
    labels = roots.select(F.col("node").alias("rep"), "root")
    labelled = written(members.join(labels, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    split = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    keys = split.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("roots > 1")
    return written(labelled.join(written(keys.select("key", "main")), "key"))


def linkable(held: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep, n_shingles, sig and lonely of documents that can have a link to another component.

    lonely counts shingles that no other document of an open key has: they are no part of any such link's intersection.
    """
    docs = held.select("rep").distinct()
    each = sets.join(docs, "rep", "left_semi").select("rep", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("docs"), F.min("rep").alias("rep")).filter("docs = 1")
    lonely = alone.groupBy("rep").agg(F.count("*").alias("lonely"))
    out = docs.join(lonely, "rep", "left").join(reps, "rep").select("rep", "n_shingles", "sig", F.coalesce("lonely", F.lit(0)).cast("bigint").alias("lonely"))
    return out.filter(100 * (F.col("n_shingles") - F.col("lonely")) >= percent * F.col("n_shingles"))


def central_pairs(held: DataFrame, able: DataFrame) -> DataFrame:
    """(a, b): each document outside its keys' main components and, of these components' members, the least lonely one."""
    share = able.select("rep", (F.col("lonely") / F.col("n_shingles")).alias("share"))
    alive = held.join(share, "rep")
    hubs = written(alive.filter("root = main").groupBy("key").agg(F.min_by("rep", F.struct("share", "rep")).alias("hub"), F.min("share").alias("least")))
    return alive.filter("root <> main").join(hubs, "key").groupBy(F.col("rep").alias("a")).agg(F.min_by("hub", F.struct("least", "hub")).alias("b"))


def crossing_pairs(held: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """All (a, b) of different components that share a key, lie within the radius and whose lonely shingles leave a link possible."""
    value = F.expr("shiftright(get(sig, cast(slot div 4 as int)), cast(16 * (slot % 4) as int)) & 65535")
    alive = held.join(able, "rep").withColumn("out", value)
    one = alive.filter("root <> main").select("key", "slot", "main", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"), F.col("lonely").alias("la"), F.col("sig").alias("siga"), F.col("out").alias("oa"))
    two = alive.select(F.col("key").alias("key2"), F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"), F.col("lonely").alias("lb"), F.col("sig").alias("sigb"), F.col("out").alias("ob"))
    chunks = chunks_for(percent)
    starts = chunk_starts(chunks)
    spans = ", ".join(f"named_struct('first', {a}, 'last', {b - 1})" for a, b in zip(starts, [*starts[1:], POSITIONS], strict=True))
    errors = "size(filter(sequence(c.first, c.last), k -> (shiftright(get(siga, cast(k div 4 as int)) ^ get(sigb, cast(k div 4 as int)), cast(16 * (k % 4) as int)) & 65535) <> 0))"
    pairs = one.join(
        two,
        (F.col("key") == F.col("key2"))
        & (F.col("ra") != F.col("rb"))
        & ((F.col("rb") == F.col("main")) | (F.col("ra") < F.col("rb")))
        # equal chunks share all their keys: the first one is enough
        & ((F.col("oa") != F.col("ob")) | F.col("slot").isin(*starts))
        & (100 * F.least(F.col("na") - F.col("la"), F.col("nb") - F.col("lb")) >= percent * F.greatest(F.col("na") + F.col("lb"), F.col("nb") + F.col("la")))
        & (distance("siga", "sigb") <= radius(chunks))
        # and so is the first chunk that tolerates the pair
        & F.expr(f"forall(array({spans}), c -> c.last >= slot OR {errors} >= 2)"),
    )
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One document of each group, with its columns; documents without words stay."""
    gone = near_duplicates(docs, id_col, text_col, percent).filter("NOT kept").select(F.col("doc_id").alias("nd_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["nd_gone"], "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, w.doc_id = c.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) c ON c.node = w.doc_id
"""
