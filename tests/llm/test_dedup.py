import hashlib
import random
import re

import pandas as pd
from helpers import no_documents, odd_documents, words

from sparkloom.llm import exact_dedup, near_dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n])[1]
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_exact_against_brute_force(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_exact(rows)
    kept = exact_dedup.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 6, 7, 8, 9, 10, 11] and kept.columns == docs.columns
    assert exact_dedup.exact_dedup(no_documents(spark)).count() == 0 and exact_dedup.keep_one(no_documents(spark)).count() == 0


def test_fewer_rows_reach_each_level(spark):
    texts = ["a" * n for n in range(100, 160)] + [c * 200 for c in "bcdefghijk"] + ["m" * 90 + str(k) for k in range(10, 20)] + ["n" * 300] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    narrow = exact_dedup.normalised(docs, "doc_id", "text").selectExpr("len", "substring(norm, 1, 64) prefix")
    one = exact_dedup.same_length(narrow)
    two = exact_dedup.same_prefix(one)
    # lengths are shared by the second to fourth kind, prefixes by the last two, whole texts by the last
    assert narrow.count() == 85 and one.count() == 25 and sorted(r["n"] for r in two.collect()) == [5, 10]
    got = exact_dedup.exact_dedup(docs)
    assert got.filter("text_sha256 IS NOT NULL").count() == 15 and got.filter("group_size > 1").count() == 5


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows, percent=85):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family():
    """Copies with up to six edits of one text, which link in chains, beside plain texts, case copies and texts without words."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(120)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"z{rng.randrange(10**5)}" for _ in range(60))) for i in range(160, 200)]
    rows += [(i, rows[i - 200][1].upper() + " \n") for i in range(200, 210)]
    rows += [(210, None), (211, ""), (212, "one two"), (213, "ONE two "), (214, " ")]
    rng.shuffle(rows)
    return rows


def test_near_against_brute_force(spark):
    rows = family()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_near(rows)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def brute_kept(rows, percent):
    """Ids that are the least of their group where pairs at the threshold link."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return sorted(i for i in ids if root[i] == i)


def test_keep_one_links_at_four_fifths(spark):
    rows = [(i, t) for i, t in family() if t]
    # pairs of 96 shingles each that share 86: 86 / 106 = 0.81
    for k in range(300, 340, 2):
        w = [f"p{k}x{n}" for n in range(100)]
        rows += [(k, " ".join(w)), (k + 1, " ".join(["new" if n in (30, 60) else x for n, x in enumerate(w)]))]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows, 80) != brute_kept(rows, 85)
    assert near_dedup.chunks_for(85) == near_dedup.CHUNKS < near_dedup.chunks_for(80)


def test_near_odd_tables(spark):
    got = near_dedup.near_duplicates(odd_documents(spark)).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == [1, 1, 3, 4, 5, 6, 7, 7, 9, 10, 10, 11]
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


def test_near_ids_on_several_texts(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(80)) for c in "xyz")
    near = lambda t, k: " ".join("new" if n == k else w for n, w in enumerate(t.split()))
    rows = [(1, one), (5, near(one, 3)), (5, two), (7, near(two, 4)), (9, near(two, 70)), (9, three), (12, near(three, 9)), (20, "alone with nothing near it at all"), (20, None), (5, two)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got.itertuples()} == {1: 1, 5: 1, 7: 1, 9: 1, 12: 1, 20: 20}
    assert got[got.doc_id == 20].n_shingles.sort_values().tolist() == [0, 3]


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (105, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(chain).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 105: 100}


def test_every_pair_within_radius_shares_a_key(spark):
    rng = random.Random(5)
    one = [rng.randrange(1 << 16) for _ in range(near_dedup.POSITIONS)]
    rows = [(0, one)]
    for k in range(1, 80):
        other = list(one)
        for p in rng.sample(range(near_dedup.POSITIONS), near_dedup.RADIUS):
            other[p] = (other[p] + 1 + rng.randrange(1000)) % (1 << 16)
        rows.append((k, other))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    packed = [(k, [signed(sum(v[4 * i + j] << 16 * j for j in range(4))) for i in range(12)]) for k, v in rows]
    df = spark.createDataFrame(packed, "rep long, sig array<long>")
    keys = {r["rep"]: set(r["keys"]) for r in df.selectExpr("rep", "sig").withColumn("keys", near_dedup.F.array(*near_dedup.chunk_keys())).collect()}
    assert all(keys[0] & keys[k] for k in range(1, 80))
    far = df.selectExpr("rep b", "sig sigb").crossJoin(df.filter("rep = 0").selectExpr("sig siga")).withColumn("d", near_dedup.distance("siga", "sigb"))
    assert {r["d"] for r in far.filter("b > 0").collect()} == {near_dedup.RADIUS}


def test_sql_of_near_dedup_matches(spark, duck):
    a = near_dedup.op3_near_dedup(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    b = duck.execute(near_dedup.SQL).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False)
