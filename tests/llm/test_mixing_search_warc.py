import gzip
import time
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from helpers import no_documents, odd_documents
from pyspark.sql import functions as F

from sparkloom.llm import mixing, topk, warc


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, 166.66666666666666, 83.33333333333333]
    assert mixing.targets([10, 1000], [5, 2]) == [20, 1495]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_leaf_quotas_are_exact():
    blocks, quotas = np.array([1024, 1024, 64, 1024]), np.array([1000, 7, 0, 333])
    start, pool, quota = mixing.leaf_quotas(0, 13, 13, blocks, quotas, 5)
    assert (pool.sum(axis=0) == blocks).all() and (quota.sum(axis=0) == quotas).all() and (quota >= 0).all() and (quota <= pool).all()
    assert (start == np.cumsum(pool, axis=0) - pool).all() and pool.sum(axis=1).max() - pool.sum(axis=1).min() <= 4
    # any range of leaves is drawn alike
    for lo, hi in ((0, 1), (4, 9), (12, 13)):
        assert all((x == y[lo:hi]).all() for x, y in zip(mixing.leaf_quotas(lo, hi, 13, blocks, quotas, 5), (start, pool, quota), strict=True))


def brute_draws(rows, shard_words, seed=7, weights=(5.0, 2.0, 1.0)):
    """rows are (id, source, size, at); times that each id is drawn, from the description of the method, step by step."""
    names = sorted({s for _, s, _, _ in rows})
    sizes = [sum(n for _, s, n, _ in rows if s == name) for name in names]
    goals = mixing.targets(sizes, [weights[k % 3] for k in range(len(names))])
    count = max(mixing.BLOCKS, 1 << (len(rows) // mixing.BLOCK_ROWS).bit_length())
    passes = [min(int(g // s), 2) for g, s in zip(goals, sizes)]
    rests = [g - p * s for g, p, s in zip(goals, passes, sizes)]
    quotas = np.array([round(count * r / s) for r, s in zip(rests, sizes)])
    shards = max(mixing.SHARDS, round(sum(goals) / shard_words))
    start, pool, quota = mixing.leaf_quotas(0, shards, shards, np.full(len(names), count), quotas, seed)
    odd = np.random.Generator(np.random.PCG64(seed)).integers(0, count, (len(names), 2)) | 1
    out = {}
    for k, name in enumerate(names):
        held = {}
        for i, s, n, at in rows:
            if s == name:
                held.setdefault((at >> 20) % count, []).append((at, i, n))
        order = []
        for block in held:
            turned = (block * int(odd[k, 0]) + int(odd[k, 1])) % count
            place = turned ^ (turned >> max(count.bit_length() // 2, 1))
            shard = int(np.searchsorted(np.cumsum(pool[:, k]), place, side="right"))
            order.append((place >= start[shard, k] + quota[shard, k], shard, place, block))
        left, more, idle = rests[k], set(), []
        for _, _, _, block in sorted(order):
            whole = sum(n for _, _, n in held[block])
            if left <= 0:
                idle += held[block]
            elif whole <= left:
                more |= {i for _, i, _ in held[block]}
                left -= whole
            else:
                at_block, before = sorted(held[block]), 0
                for at, i, n in at_block:
                    before += n
                    if before <= left:
                        more.add(i)
                    else:
                        idle.append((at, i, n))
                left -= sum(n for _, i, n in at_block if i in more)
                idle += [x for _, _, _, b in sorted(order)[[o[3] for o in sorted(order)].index(block) + 1 :] for x in held[b]]
                break
        near = [(abs(n - left), at, i) for at, i, n in idle if n > 0 and abs(n - left) < left]
        if near:
            more.add(min(near)[2])
        for block in held.values():
            for _, i, _ in block:
                out[i] = passes[k] + (i in more)
    return out


def test_mix_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), str(rng.choice(["a", "b", "c"], p=[0.45, 0.1, 0.45]))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=500).toPandas()
    source = {k: s for k, _, s in rows}
    want = brute_draws([(r.doc_id, source[r.doc_id], r.size_, r.at) for r in got.rename(columns={"size": "size_"}).itertuples()], 500)
    have = {r.doc_id: len(r.draws) for r in got.itertuples()}
    assert have == want and {len(d) for d in got.draws} >= {0, 1, 2}

    # the tree decides: with all of it in one shard other documents are drawn
    def flat(spark, shards, blocks, quotas, seed):
        return spark.createDataFrame([(k, 0, 0, int(b), int(q)) for k, (b, q) in enumerate(zip(blocks, quotas))], "number int, shard bigint, start bigint, pool bigint, quota bigint")

    monkeypatch.setattr(mixing, "leaves", flat)
    other = {r.doc_id: len(r.draws) for r in mixing.mix(docs, shard_words=500).toPandas().itertuples()}
    assert sum(other[k] != have[k] for k in have) > 100


def test_mixed_repeated_ids(spark):
    rows = [(k % 50, " ".join(["w"] * (1 + k % 30)), None if k % 5 == 0 else "b", k) for k in range(400)] + [(7, "w w", "b", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at long")
    taken = mixing.mixed(docs).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n"), F.count("*").alias("rows")).collect()
    plan = {r["target"]: r["n"] for r in mixing.mix(docs).groupBy("target").agg(F.sum(F.col("size") * F.size("draws")).alias("n")).collect()}
    assert sorted(r["n"] for r in taken) == sorted(plan.values()) and all(abs(t - n) < 30 for t, n in plan.items())
    assert mixing.mixed(docs).columns == docs.columns


def test_mix(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 37 % 50)), "abc"[k % 3] if k % 4 else "a") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=4000).toPandas()
    of = {k: s for k, _, s in rows}
    got["source"], got["n"] = got.doc_id.map(of), got.draws.map(len)
    got["taken"] = got.n * got["size"]
    sums = got.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.said).all() and ((sums.taken - sums.target).abs() <= 25).all() and got.n.max() <= 2
    assert sums.target.round(6).tolist() == [round(x, 6) for x in mixing.targets(sums["size"].tolist(), [5, 2, 1])]
    again = mixing.mix(docs.repartition(7), shard_words=4000).toPandas().set_index("doc_id").sort_index()
    assert again.draws.map(lambda d: [tuple(x) for x in d]).tolist() == got.set_index("doc_id").sort_index().draws.map(lambda d: [tuple(x) for x in d]).tolist()
    out = mixing.mixed(docs, shard_words=4000)
    assert out.columns == docs.columns and out.count() == got.n.sum()


def test_mix_odd_tables(spark):
    got = mixing.mix(odd_documents(spark)).toPandas()
    assert len(got) == 12 and got[got.doc_id == 4]["size"].tolist() == [0] and got["size"].sum() == 6 + 6 + 1 + 20_000 + 20_001 + 2 + 2 + 2 + 7
    assert mixing.mix(no_documents(spark)).count() == 0 and mixing.mixed(no_documents(spark)).count() == 0


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    rng = np.random.default_rng(1)
    codes = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    codes[200:260] = codes[0]  # one code that many rows share
    rows = [(k, int(c)) for k, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, (None, 5), rows[3]], "vec_id long, code long")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["vec_id"])
    for q in range(0, 400, 50):
        near = sorted((int(np.bitwise_count(np.uint64(np.int64(codes[q] ^ codes[k]).view(np.uint64)))), k) for k in range(400) if k != q)
        assert [got[q][k] for k in range(1, 8)] == near[:7]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2


def test_index_does_less_than_a_scan():
    codes = np.random.default_rng(5).integers(0, 1 << 63, topk.BLOCK, dtype=np.uint64) * np.uint64(2)
    index = topk.Index(codes)
    for row in range(0, len(codes), len(codes) // 8):
        rows, distances = index.search(codes[row], row, 10)
        every = np.bitwise_count(codes ^ codes[row]).astype(np.int64)
        every[row] = 99
        assert sorted(distances)[:10] == sorted(every)[:10] and index.verified < len(codes) / 4
        near = index.search(codes[row], row, 10, 4)[0]
        assert set(near) == set(np.flatnonzero(every <= 4)) and not index.met.any()


def test_topk_repeated_ids_and_codes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "SLICE", 30)
    rng = np.random.default_rng(6)
    rows = [(k, 5 if k % 3 else int(rng.integers(-(1 << 62), 1 << 62)), "x") for k in range(300)] + [(7, 4, "y"), (7, 9, "y"), (None, 5, "z"), (400, None, "z")]
    codes = spark.createDataFrame(rows, "vec_id long, code long, block string")
    got = topk.top_k(codes, codes.filter("vec_id % 2 = 1")).collect()
    own = {}
    for i, c, _ in rows:
        if i is not None and c is not None:
            own[i] = min(c, own.get(i, c))
    want = {(q, r + 1, v, d) for q in own if q % 2 == 1 for r, (d, v) in enumerate(sorted((((own[q] ^ c) & (1 << 64) - 1).bit_count(), v) for v, c in own.items() if v != q)[:10])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got} == want
    assert topk.top_k(codes.limit(0), codes).count() == 0 and topk.top_k(codes, codes.limit(0)).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 63 + [0.0]), (3, None), (4, [1.0, None])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["code"] for r in topk.sign_codes(df).collect()} == {1: -1, 2: -(1 << 63), 3: 0, 4: 1}


PAGE = "<html lang=de><head><title>A &amp; B</title><script>x<y</script></head><body><p>One<br>two <b>three</b><!-- no --> <a href='/q?a=1&amp;b=2'>l</a><a href=\"http://z/\">m</a></p></body></html>"


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://h.example/a/", PAGE, 0), (2, None, None, 0), (3, "http://h/\r\nX: y", "plain", 0), (3, "http://h/\r\nX: y", "plain", 0)], "page_id long, url string, html string, warc int")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    text = next(r for r in rows if r["page_id"] == 1 and r["type"] == "conversion")
    meta = next(r for r in rows if r["page_id"] == 1 and r["type"] == "metadata")
    assert bytes(text["block"]).decode() == "A & B\nOne\ntwo three lm"
    fields = bytes(meta["block"]).decode()
    assert "title: A & B\r\n" in fields and "language: de\r\n" in fields and "outlink: http://h.example/q?a=1&b=2\r\n" in fields and "outlink: http://z/\r\n" in fields
    for r in rows:
        assert r["refers_to"] == r["headers"]["WARC-Refers-To"] == r["source_headers"]["WARC-Record-ID"]
        assert r["payload_digest"] == r["source_headers"]["WARC-Payload-Digest"] and r["block_digest"] == warc.digest(bytes(r["block"]))
        assert r["headers"]["WARC-Date"] == r["source_headers"]["WARC-Date"] and "http:Content-Type" in r["source_headers"]
    for r in warc.as_records(warc.derive(warc.responses(pages))).collect():
        headers, block = warc.parse(bytes(r["warc"]))
        assert headers["WARC-Block-Digest"] == warc.digest(block) and int(headers["Content-Length"]) == len(block)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    broken = spark.createDataFrame([(1, b""), (2, None), (3, b"WARC/1.1\r\nWARC-Type: request\r\n\r\nx"), (4, b"WARC/1.1\r\nWARC-Type: response\r\n\r\nnothing")], "page_id long, warc binary")
    assert {r["page_id"] for r in warc.derive(broken).collect()} == {4}


def test_plain_text_of_unclosed_markup():
    assert warc.plain_text("a<!-- b") == "a" and warc.plain_text("a<script>b") == "a" and warc.plain_text("1 < 2 &lt; 3") == "1 < 2 < 3" and warc.plain_text("") == ""
    assert warc.plain_text("x" * 200_000) == "x" * 200_000


def test_long_pages_of_unclosed_markup():
    began = time.perf_counter()
    for piece in ("<a", "<html", "<title", "<!", "<a href=", "<a href='", "<script", "</script", "&#1", "<!-", "<p lang=", "< ", "<a href=x <"):
        for page in (piece * (1_000_000 // len(piece)), piece * (300_000 // len(piece)) + ">" + piece * (300_000 // len(piece))):
            warc.read_page(page, "http://h/")
    assert warc.read_page("&#" + "1" * 10_000 + "; &#" + "0" * 10_000 + "65;").text == "\ufffd A"
    assert time.perf_counter() - began < 40


class Plain(HTMLParser):
    """Text and anchors as another parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.BLOCKS:
            self.out.append("\n")
        if tag in warc.RAW:
            self.hidden.append(tag)
        elif tag == "a" and not self.hidden and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"].strip())

    def handle_endtag(self, tag):
        if tag in warc.BLOCKS and not self.hidden:
            self.out.append("\n")
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_pages_against_another_parser():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    same = 0
    for url, page in zip(pages.url, pages.html, strict=True):
        own, other = warc.read_page(page or "", url or ""), Plain()
        other.feed(page or "")
        other.close()
        assert own.links == list(dict.fromkeys(urljoin(url or "", x) for x in other.links))
        same += own.text.split() == "".join(other.out).split()
    assert same == len(pages)


def test_warc_encodings(spark):
    body = "<html lang=fr><title>été</title><p>un &amp; deux</p>".encode()
    chunked = b"".join(b"%x;n=1\r\n%s\r\n" % (len(body[k : k + 9]), body[k : k + 9]) for k in range(0, len(body), 9)) + b"0\r\n\r\n"
    packed = gzip.compress(body)
    cases = [("", "", body), ("Transfer-Encoding: chunked", "", chunked), ("", "Content-Encoding: gzip", packed), ("content-encoding: deflate", "", zlib.compress(body)), ("", "Content-Encoding: gzip", body), ("Transfer-Encoding: chunked", "", body)]
    rows = []
    for k, (a, b, payload) in enumerate(cases):
        fields = "\r\n".join(x for x in ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", a, b) if x)
        rows.append((k, b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\n\r\n" + fields.encode() + b"\r\n\r\n" + payload))
    got = warc.derive(spark.createDataFrame(rows, "page_id long, warc binary")).collect()
    assert [bytes(r["block"]).decode() for r in got if r["type"] == "conversion"] == ["été\nun & deux"] * 6
    assert all(b"title: \xc3\xa9t\xc3\xa9\r\nlanguage: fr\r\n" in bytes(r["block"]) for r in got if r["type"] == "metadata")
    assert {r["page_id"]: r["headers"]["WARC-Payload-Digest"] for r in got} == {0: warc.digest(body), 1: warc.digest(body), 2: warc.digest(packed), 3: warc.digest(zlib.compress(body)), 4: warc.digest(body), 5: warc.digest(body)}


def test_warc_ids_of_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (1, "u", "b")], "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 6 and len({r["record_id"] for r in got}) == 4 and len({r["refers_to"] for r in got}) == 2


def test_topk_sql(spark, duck):
    a = topk.op8_topk(spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "distance").toPandas()
    b = duck.execute(f"SELECT query_id, rank, vec_id, distance FROM ({topk.SQL}) ORDER BY 1, 2").df()
    assert a.equals(b.astype(a.dtypes.to_dict())) and F is not None
