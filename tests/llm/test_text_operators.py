import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from helpers import no_documents, odd_documents

from sparkloom.llm import bpe, ctw, licenses, pii, toxicity

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c_d@e.f, x@y.z@w.v", "1.2.3.45.6.7.8 300.1.1.1 001.002.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (262) 555-6681. +49-30-1234567 +1", "😀 é a.b@c.de 😀 8.8.8.8",
    "..a@b.c.. @x.y a@.b", "5" * 400 + " " + "1.1.1.1" * 50, "x" * 3000 + "@" + "y.z", "+1" + "(" * 3000, None, "", "no data here", " ".join(f"u{k}@h{k}.org" for k in range(700)),
]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").unionByName(odd_documents(spark).selectExpr("doc_id + 100 doc_id", "text"))
    rows = df.collect()
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(df).select("doc_id", pii._joined(pii.F.col("base_spans")).alias("s")).collect()}
    assert got == {r["doc_id"]: spans(r["text"]) for r in rows}
    assert pii.find_pii(no_documents(spark)).count() == 0


def test_pii_contexts_discover(spark):
    rows = [(k, f"text {k} please call +1 (212) 555-{k:04d} now") for k in range(10, 20)] + [(1, "word please call 212 555 7788 now"), (2, "the year 1999123456 of it")]
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii._joined(pii.F.col("spans")).alias("s")).collect()}
    assert got[1] == "phone:17:29" and got[2] == ""
    assert all(got[k] == spans(t) for k, t in rows if k >= 10)


def brute_discovery(rows, rounds=3, accept=0.7, support=3.0):
    """Spans of each document beside its base ones, from scores over all pairs of patterns and tokens."""
    seen = []
    for i, text in rows:
        own = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans(text).split(",") if x)]
        last = 0
        for m in regex.finditer(pii.TOKEN, text or ""):
            token = regex.sub("[^A-Za-z0-9]+$", "", m[0])
            before, last = text[last : m.start()], m.end()
            before = regex.sub(r"[\x20\x09-\x0D(]+$", "", before)
            pattern = " ".join([w for w in regex.split(r"[\x20\x09-\x0D]+", before) if w][-2:]).lower()
            s, e = m.start(), m.start() + len(token)
            seed = next((k for kind in pii.KINDS for k, a, b in own if k == kind and a < e and b > s), None)
            if token and pattern:
                seen.append((i, s, e, token.lower(), pattern, seed))
    edges = {(p, t) for _, _, _, t, p, _ in seen}
    belief = {(t, k): 1.0 for _, _, _, t, _, k in seen if k}
    fits = lambda t, k: "@" in t if k == "email" else sum(c.isdigit() for c in t) >= 6
    scores = {}
    for _ in range(rounds):
        scores = {}
        for p, t in edges:
            for k in pii.KINDS:
                if (t, k) in belief:
                    scores[p, k] = scores.get((p, k), 0) + belief[t, k]
        tokens = Counter(p for p, _ in edges)
        scores = {(p, k): h / tokens[p] for (p, k), h in scores.items() if h >= support and h / tokens[p] >= accept}
        for p, t in edges:
            for k in pii.KINDS:
                if (p, k) in scores and fits(t, k):
                    belief[t, k] = max(belief.get((t, k), 0), scores[p, k])
    out = set()
    for i, s, e, t, p, seed in seen:
        kinds = [(scores[p, k], -pii.KINDS.index(k), k) for k in pii.KINDS if (p, k) in scores]
        if not seed and kinds and fits(t, max(kinds)[2]):
            out.add((i, max(kinds)[2], s, e))
    return out


def test_pii_discovery_against_brute_force(spark):
    rows = [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(k, f"text {k} please   call\n+1 (212) 555-{k:04d} now, server at ({k}.1.2.3)") for k in range(10, 30)] + [(1, "word please call 212 555 7788 now"), (2, "the year 1999123456 of it " * 40)]
    rows += [(3, "x" * 5000 + " please call 212 555 7799"), (4, "please " + "y" * 5000 + " 212 555 7799 server at 10.0.0.999999"), (5, None), (6, "")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    more = {(r["doc_id"], pii.KINDS[x["kind"]], x["s"], x["e"]) for r in got for x in r["spans"] if x not in r["base_spans"]}
    assert more == brute_discovery(rows) and {(1, "phone", 17, 29), (3, "phone", 5013, 5025)} <= more


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, tiktoken_encoding):
    df = odd_documents(spark).unionByName(spark.createDataFrame([(50, "<|endoftext|> 一丁 \x00 ﷺ   \r\n\t" + "ab" * 5000, *[None] * 7)], odd_documents(spark).schema))
    rows = bpe.decode(bpe.encode(df)).collect()
    assert len(rows) == df.count() and set(df.columns) < set(rows[0].asDict())
    for r in rows:
        assert list(r["ids"]) == tiktoken_encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(no_documents(spark))).count() == 0


def test_bpe_forgets_without_loss(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 5)
    own = bpe.Codec(*bpe.default_vocabulary())
    for k in range(20):
        text = f"some words {k} and {k * 7919} " + "z" * 100
        assert own.encode([text])[0].tolist() == tiktoken_encoding.encode_ordinary(text)


def test_licenses(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "LICENSED  under the apache licence; version 2.0"), (3, "Copyright (c) 2020 Me\n" + licenses._MIT), (4, "prose\nReleased under the MIT License.\nmore"), (5, "I like the Apache License a lot"), (6, None), (7, ""), (8, licenses._ISC + "\n\nprose " * 9000)]
    got = {r["doc_id"]: (r["license"], list(r["notices"])) for r in licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("Apache-2.0", []) and got[2][0] == "Apache-2.0" and got[3][0] == "MIT"
    assert got[4] == (None, ["MIT@line:2"]) and got[5] == (None, []) and got[6] == (None, []) and got[7] == (None, [])
    assert licenses.document_licenses(odd_documents(spark)).count() == 12 and licenses.document_licenses(no_documents(spark)).count() == 0


def test_full_licenses_inside_documents(spark):
    texts = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")} | {"MIT": licenses._MIT, "ISC": licenses._ISC}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "MIT", "ISC"} == set(texts)
    assert all(regex.search(licenses.MARK, text) for _, text in licenses.known_texts())
    names = sorted(texts)
    rows = [(f"{n} alone", texts[n]) for n in names]
    rows += [(f"{n} inside", "Some tool\r\n \r\nCopyright (c) 2020 Me\r\n\r\n" + texts[n].strip().replace("\n", "\r\n") + "\r\n\r\nmore prose") for n in names]
    rows += [(f"{n} titled", licenses.NAMES[n][0].removeprefix("the ") + "\n\nCopyright (c) 2020 Me\n\n" + texts[n]) for n in names]
    rows += [("MIT joined", "// MIT License\n//\n" + "".join(f"// {x}\n" for x in licenses._MIT.split("\n")) + "int main() {}"), ("cut", licenses._MIT[:-20] + "\nprose"), ("longer", "x\n" + licenses._MIT[:-1] + "s.")]
    header = licenses.TEXTS.joinpath("Apache-2.0.txt").read_text().partition("[name of copyright owner]")[2]
    rows += [("header", "#!/bin/sh\n# Copyright 2020 Me\n" + "".join(f"# {x.strip()}\n" for x in header.strip().split("\n")) + "echo")]
    got = {r["doc_id"]: (r["license"], list(r["notices"])) for r in licenses.document_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for n in names:
        assert got[f"{n} alone"][0] == n and got[f"{n} titled"][0] == n
        assert got[f"{n} inside"][0] is None and f"{n}@run:5" in got[f"{n} inside"][1]
    assert "MIT@run:3" in got["MIT joined"][1] and "Apache-2.0@run:3" in got["header"][1]
    assert not any("@run" in x for k in ("cut", "longer") for x in got[k][1])


def plain_canonical(text):
    out = regex.sub(r"(?m)^[\x20\x09]*(?:[*#/;-]+[\x20\x09]*)?(?:copyright|\(c\)|©|all rights reserved)[^\n]*$", " ", (text or "").lower())
    out = " ".join(regex.findall(r"[\p{L}\p{N}]+", out))
    for a, b in sorted(licenses.EQUAL.items(), key=lambda x: -len(x[0])):
        out = regex.sub(rf"\b{a.replace('-', ' ')}\b", b, out)
    return out


def plain_licenses(text, known, full):
    """(license of the whole text, notices) by comparing every unit's canonical text with every known one."""
    text, notices = text or "", []
    lines, paragraphs = text.split("\n"), regex.split(licenses.BLANK, text)
    for unit, parts in (("line", lines), ("paragraph", paragraphs)):
        if len(parts) > 1:
            notices += [f"{known[c]}@{unit}:{k}" for k, part in enumerate(parts, 1) if (c := plain_canonical(part)) in known]
    if len(lines) > 1:
        for k in range(len(lines)):
            rest = plain_canonical("\n".join(lines[k:]))
            head = plain_canonical(lines[k])
            if head:
                notices += {f"{name}@run:{k + 1}" for name, whole in full if (rest + " ").startswith(whole + " ") and whole.startswith(" ".join(head.split()[:2]))}
    return known.get(plain_canonical(text)), sorted(notices)


def test_licenses_against_brute_force(spark):
    known = {}
    for name, text in licenses.known_texts():
        c = plain_canonical(text)
        known[c] = min(name, known.get(c, name))
        assert regex.search(licenses.MARK.replace("(?i)", ""), text, regex.I), text[:80]
    full = [(name, plain_canonical(text)) for name, text in licenses.full_texts()]
    odd = ["Released under _MIT_", "GPL_3.0\nand more", "x\n__Apache-2.0__\ny", "permit the limit\nMITx", "a\n\nMIT\n\n" + licenses._ISC, "# MIT License\n\n" + licenses._MIT + "\nend", "Licensed under the MIT licence.\n(c) 2020 x\n", None, "", "©"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        r = got[k]
        assert (r["license"], r["notices"], r["canonical_sha256"]) == (*plain_licenses(text, known, full), hashlib.sha256(plain_canonical(text).encode()).hexdigest()), (k, text)
    assert [got[k]["license"] for k in (0, 6)] == ["MIT", "MIT"] and "Apache-2.0@line:2" in got[2]["notices"] and "GPL-3.0-only@line:1" in got[1]["notices"]


def test_log_kt():
    for a, b in ((0, 0), (3, 0), (2, 5), (40, 1)):
        p, zeros, ones = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            p += math.log(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
            zeros, ones = zeros + (not bit), ones + bit
        assert ctw.log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(p, abs=1e-6)


class PlainTree:
    """The mixture by its definition, with dictionaries of every context and node."""

    def __init__(self, texts):
        self.counts = {}
        for t in texts:
            for context, byte in self.runs(t):
                for depth in range(ctw.DEPTH + 1):
                    for node, bit in self.nodes(byte):
                        self.counts.setdefault((context[ctw.DEPTH - depth :], node), [0, 0])[bit] += 1
        self.children = {}
        for context, node in self.counts:
            if context:
                self.children.setdefault((context[1:], node), []).append((context, node))
        self.mixed = {}

    @staticmethod
    def runs(text):
        data = b" ".join(text.encode().lower().split()) + b"\n"
        padded = b"\n" * ctw.DEPTH + data
        return [(padded[k : k + ctw.DEPTH], data[k]) for k in range(len(data))]

    @staticmethod
    def nodes(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def own(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, key):
        return sum(self.log_mixed(c) for c in self.children.get(key, ()))

    def log_mixed(self, key):
        if key not in self.mixed:
            self.mixed[key] = self.own(key) if len(key[0]) == ctw.DEPTH else np.logaddexp(self.own(key), self.below(key)) - math.log(2)
        return self.mixed[key]

    def score(self, text):
        total = 0.0
        for context, byte in self.runs(text):
            for node, bit in self.nodes(byte):
                p = 0.5
                for depth in range(ctw.DEPTH, -1, -1):
                    key = (context[ctw.DEPTH - depth :], node)
                    a, b = self.counts.get(key, (0, 0))
                    kt = ((b if bit else a) + 0.5) / (a + b + 1)
                    w = 1.0 if depth == ctw.DEPTH and a + b else 1 / (1 + math.exp(self.below(key) - self.own(key))) if a + b else 0.5
                    p = w * kt + (1 - w) * p
                total += math.log10(p)
        return total


@pytest.mark.parametrize(("fan", "stored"), [(64, True), (2, True), (64, False)])
def test_ctw_against_definition(spark, tmp_path, monkeypatch, fan, stored):
    monkeypatch.setattr(ctw, "FAN", fan)
    docs = odd_documents(spark).filter("doc_id NOT IN (7, 8)").unionByName(odd_documents(spark).filter("doc_id = 1").selectExpr("cast(null as long) doc_id", "'the cat sat on the mat' text", *[c for c in odd_documents(spark).columns if c not in ("doc_id", "text")]))
    if stored:
        docs.repartition(3).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    assert ctw.sizes(3) == ([2, 1] if fan == 2 else [1])
    rows = docs.collect()
    train = [r["text"] or "" for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    tree, tokens = PlainTree(train), Counter()
    for t in train:
        tokens.update([*t.encode().lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    got = ctw.score_texts(docs).collect()
    assert len(got) == len(rows)
    texts = Counter((r["doc_id"], r["text"] or "") for r in rows)
    by_id = {i: t for i, t in texts}
    for r in got:
        t = by_id[r["doc_id"]]
        own = [*t.encode().lower().split(), None]
        assert r["score"] == pytest.approx(tree.score(t), abs=2e-3 + 1e-6 * len(t))
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(tokens[w] > 0 for w in own), n)


def test_ctw_probabilities_add_up():
    keys = np.arange(256, dtype=np.uint32) | np.uint32(7 << 8)
    nodes = ctw.Nodes(np.array([97 | 7 << 8, 98 | 7 << 8, 97 | 9 << 8], dtype=np.uint32), np.array([5, 2, 1]))
    near = (np.full((256, 256), 0.3), np.full((256, 256), 0.4), np.full(256, 0.2), np.full(256, 0.6))
    assert (10 ** nodes.predict(keys, near, 3)).sum() == pytest.approx(1.0)


def test_ctw_empty(spark, tmp_path):
    no_documents(spark).write.parquet(str(tmp_path / "e"))
    assert ctw.score_texts(spark.read.parquet(str(tmp_path / "e"))).count() == 0 and ctw.score_texts(no_documents(spark)).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 8 == 0
        w = [f"{a}{b}" for a, b in rng.choice(["ba", "ko", "ti", "re", "mu", "lo"], (60, 2))]
        if toxic:
            w[int(rng.integers(60))] = "grumf" + str(rng.choice(["el", "an", "ix"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic), 1))
    rows += [(5000, None), (5001, ""), (5002, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k] >= 0.3) == (k % 8 == 0) for k in held) / len(held)
    assert right > 0.97 and len(got) == 1203 and got[5000] == got[5001] < 0.3
    # labels of held-out rows don't matter
    flipped = known.withColumn("toxic", toxicity.F.when(toxicity.F.crc32(known["doc_id"].cast("string")) % 4 == 2, 1 - known["toxic"]).otherwise(known["toxic"]))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert again == got
    clean = toxicity.keep_clean(docs, model)
    assert {r["doc_id"] for r in clean.collect()} == {k for k, x in got.items() if x < 0.3}
    none = toxicity.fit(docs, known.limit(0))
    assert toxicity.score(no_documents(spark), none).count() == 0 and toxicity.score(odd_documents(spark), none).count() == 12


def test_label_model_estimates_voters_and_the_label():
    rng = np.random.default_rng(4)
    n = 6000
    truth = rng.random(n) < 0.15
    rates = [(0.8, 0.02), (0.7, 0.01), (0.6, 0.03), (0.75, 0.02)]
    votes = np.stack([np.where(rng.random(n) < np.where(truth, a, b), 1, -1) for a, b in rates], axis=1)
    # a voter that repeats the first one is no news
    votes = np.hstack([votes, votes[:, :1]]).astype(np.int8)
    gold = np.where(rng.random(n) < 0.5, np.where(rng.random(n) < 0.03, 1 - truth, truth), np.nan).astype(float)
    post, found, groups = toxicity.label_model(votes, gold, 0.1)
    assert np.abs(found[:4] - rates).max() < 0.05 and abs(found[-1, 0] - 0.97) < 0.03 and found[-1, 1] < 0.06
    assert [0, 4] in groups and len(groups) == 4
    assert ((post > 0.5) == truth).mean() > 0.97
    # where there is no label, votes alone decide
    free = np.isnan(gold)
    assert ((post[free] > 0.5) == truth[free]).mean() > 0.96
    flipped = votes.copy()
    flipped[free] = -flipped[free]
    assert np.abs(toxicity.label_model(flipped, gold, 0.1)[0][free] - post[free]).mean() > 0.2


def test_toxicity_of_equal_texts_with_different_labels(spark):
    rows = [(k, "same text of all") for k in range(40)] + [(k, f"other text number{k % 7}") for k in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 2)) for k in range(80)] + [(3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample_rows(docs, known, "doc_id", "text", 100).collect()
    assert sorted((r["text"], r["toxic"]) for r in got)[-1] == ("same text of all", 1.0) and len({r["text"] for r in got}) == len(got) == 7
    assert toxicity.sample_rows(docs, known, "doc_id", "text", 10).count() <= 8
