"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Lexica are a fixed list and lists induced from labelled rows (words and word beginnings that go with the label), dealt into
voters; pattern voters look at punctuation, capitals and address. A label, where a row has one, is a voter like the others.
The label model is fitted by EM on labelled and unlabelled rows: a class prior, how often each voter votes for and against in
each class, and which voters depend on each other; voters whose votes still correlate within the classes form a group, whose
votes have one joint distribution. No accuracy is given: all are estimated, the label's too. The classifier, a logistic regression
over lexicon entries and patterns, is trained on the posteriors.

Fitting uses at most SAMPLE labelled and SAMPLE unlabelled rows, chosen by hash, none of them held out, and runs in one task;
only its weights reach the driver. Scoring is one pass over every whole text, without any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.tables import bitmap, maybe_in, table, written
from sparkloom.llm.words import OTHER, U, Words, slices

#: Labelled rows that fitting may use, and unlabelled ones.
SAMPLE = 12_000
#: The size of the classifier: lexicon entries that it knows, and the least labelled documents that an entry must be in.
ENTRIES, LEAST = 3_000, 5
#: Correlation within the classes from which voters form a group.
DEPENDENT = 0.25
#: Log odds ratio from which an entry goes with the label, and the share of toxic documents from which it may vote.
LIFT, SURE = 1.5, 0.8
#: Voters that the induced entries are dealt to.
VOTERS = 12
BEGINNINGS = (4, 5, 6, 7, 8)
# Fixed word lists.
INSULTS = "idiot moron stupid scum trash clown loser pathetic worthless disgusting dumb fool imbecile bastard jerk crap shut hate kill ugly filthy garbage vermin arschloch dummkopf idiota imbécil estúpido basura connard imbécile débile ordure".split()
ADDRESS = "you your yours yourself du dein deine dich ihr euch tu toi ton votre vous tú usted vosotros".split()


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    found = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, OTHER)
    return np.sort(found.hashes())


def entries(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and word beginning; a beginning differs from the word of the same letters."""
    doc, size = words.doc, words.end - words.start
    docs, hashes = [doc], [words.hashes()]
    for k in BEGINNINGS:
        some = np.flatnonzero(size >= k)
        docs.append(doc[some])
        hashes.append(words.sums(words.start[some], words.start[some] + k) ^ U(0x5851F42D4C957F2D * k & (1 << 64) - 1))
    return np.concatenate(docs), np.concatenate(hashes)


def patterns(raw: np.ndarray, words: Words) -> np.ndarray:
    """For each document: shares of ! and ?, of capitals, of other marks, and of words of address and of the fixed list."""
    edges = words.offsets
    size = np.maximum(np.diff(edges), 1)

    def share(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit)])
        return (sums[edges[1:]] - sums[edges[:-1]]) / size

    hashes, doc = words.hashes(), words.doc

    def among(known: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.bincount(doc[known[at] == hashes], minlength=words.docs) / np.maximum(words.count, 1)

    return np.stack(
        [
            share((raw == 33) | (raw == 63)),
            share((raw >= 65) & (raw <= 90)),
            share(np.isin(raw, np.frombuffer(b"#$%&*@^~", dtype=np.uint8))),
            among(_ADDRESS),
            among(_INSULTS),
        ],
        axis=1,
    )


_ADDRESS, _INSULTS = _hash_words(ADDRESS), _hash_words(INSULTS)
PATTERNS = 5


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    from sparkloom.llm.words import buffers

    raw, offsets = buffers(column)
    for lo, hi, words in slices(column, OTHER):
        yield lo, hi, raw[offsets[lo] : offsets[hi]], words


def entry_counts(sample: DataFrame) -> DataFrame:
    """hash, docs, toxic: documents of the sample that hold each entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for lo, _, _, words in _texts(batch["text"]):
                doc, h = entries(words)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                keys, at = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys))), pa.array(np.bincount(at, toxic[doc + lo], minlength=len(keys)).astype(np.int64))],
                    names=["hash", "docs", "toxic"],
                )

    parts = sample.mapInArrow(work, "hash bigint, docs bigint, toxic bigint")
    return parts.groupBy("hash").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


class Finder:
    """Which known entries each document holds."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[known >> U(44)] = True

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        doc, h = entries(words)
        some = np.flatnonzero(self.maybe[h >> U(44)])
        doc, h = doc[some], h[some]
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        hit = self.known[at] == h if len(self.known) else np.zeros(0, dtype=bool)
        pair = np.unique(doc[hit] * np.int64(len(self.known) or 1) + at[hit])
        return pair // (len(self.known) or 1), pair % (len(self.known) or 1)


def dependent(votes: np.ndarray, post: np.ndarray) -> list[list[int]]:
    """Groups of voters whose votes correlate within the classes, linked directly or through others."""
    rest = votes - np.where(post[:, None] > 0.5, post @ votes / max(post.sum(), 1e-9), (1 - post) @ votes / max((1 - post).sum(), 1e-9))
    spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
    tied = np.abs(rest.T @ rest / len(votes) / np.outer(spread, spread)) > DEPENDENT
    groups, left = [], list(range(votes.shape[1]))
    while left:
        group, found = [], [left.pop(0)]
        while found:
            k = found.pop()
            group.append(k)
            found += [j for j in left if tied[k, j]]
            left = [j for j in left if not tied[k, j]]
        groups.append(sorted(group))
    return groups


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float, steps: int = 40) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(posterior of class 1 of each row, accuracies, groups) by EM over a generative model.

    votes holds 1 (for), 0 (none) and -1 (against), a column a voter; gold is 1, 0 or NaN (no label). accuracies has a row a voter
    and one for the label: how often it votes for in class 1, and in class 0. Groups are those of `dependent`; a group's state is how many of
    it vote for. The label's votes are kept apart and within 0.8 and 0.999, so that the classes cannot swap.
    """
    hits = (votes > 0).astype(np.float64)
    known = ~np.isnan(gold)
    share = hits.mean(axis=1)
    post = np.where(known, np.where(gold > 0, 0.95, 0.05), np.clip(prior + share, 0.02, 0.98))
    groups = [[k] for k in range(votes.shape[1])]
    for step in range(steps):
        if step % 10 == 9:
            groups = dependent(hits, post)
        odds = np.zeros(len(votes))
        for group in groups:
            state = hits[:, group].sum(axis=1).astype(np.int64)
            one, zero = (np.bincount(state, w, minlength=len(group) + 1) + 0.5 for w in (post, 1 - post))
            odds += np.log(one / one.sum() / (zero / zero.sum()))[state]
        one, zero = ((w[known & (gold > 0)].sum() + 1) / (w[known].sum() + 2) for w in (post, 1 - post))
        one, zero = min(max(one, 0.8), 0.999), min(max(zero, 0.001), 0.2)
        odds[known] += np.where(gold[known] > 0, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        share = float(np.clip(post.mean(), 0.001, 0.999))
        post = 1 / (1 + np.exp(-np.clip(odds + np.log(share / (1 - share)), -30, 30)))
    rates = [((post @ hits[:, k] + 0.5) / (post.sum() + 1), ((1 - post) @ hits[:, k] + 0.5) / ((1 - post).sum() + 1)) for k in range(votes.shape[1])]
    return post, np.array([*rates, (one, zero)]), groups


class Sparse:
    """A 0/1 matrix by its set columns, row after row."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.columns, self.width, self.height = columns, width, len(starts) - 1
        self.rows = np.repeat(np.arange(self.height), np.diff(starts))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], minlength=self.height)

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, g[self.rows], minlength=self.width)

    def any_of(self, columns: np.ndarray) -> np.ndarray:
        wanted = np.zeros(self.width)
        wanted[columns] = 1
        return self.times(wanted) > 0


def logistic(held: Sparse, shape: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights (entries, then patterns) and bias of a ridge logistic regression on soft labels, by Adam."""
    n, m = len(y), held.width
    base = float(y.mean().clip(1e-4, 1 - 1e-4))
    w, b = np.zeros(m + shape.shape[1]), float(np.log(base / (1 - base)))
    m1, v1 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        miss = 1 / (1 + np.exp(-np.clip(held.times(w[:m]) + shape @ w[m:] + b, -30, 30))) - y
        g = np.concatenate([np.concatenate([held.turned_times(miss), shape.T @ miss]) + ridge * w, [miss.sum()]]) / n
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.99 * v1 + 0.01 * g * g
        step = 0.1 * (1 - 0.9 * t / steps) * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    shape: np.ndarray
    bias: float
    #: A row a voter of the label model and, last, the label: rates of votes for in class 1 and in class 0, as estimated.
    accuracies: np.ndarray


def _lowest(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` of the distinct ids, the ones whose hashes are lowest.

    Hashes beyond twice the expected cut don't take part, so that no task sorts more than a few times `most` rows.
    """
    share = min(1.0, 2 * most / max(ids.count(), 1))
    cut = int(-(1 << 63) + share * ((1 << 64) - 1))
    h = F.xxhash64(F.lit(5), "doc_id")
    return ids.filter(h <= F.lit(min(cut, (1 << 63) - 1))).distinct().orderBy(h, "doc_id").limit(most)


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """toxic (null: no label) and text of at most `sample` labelled and `sample` unlabelled ids, none of them held out.

    Of equal texts one row stays, with the highest of their labels; so does an id with several labels. A null id has no label.
    """
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("double").alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    own = own.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    train = base.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    picked = _lowest(own.select("doc_id"), sample).withColumn("toxic", F.lit(True)).unionByName(_lowest(train.select("doc_id"), sample).withColumn("toxic", F.lit(False)))
    picked = written(picked.groupBy("doc_id").agg(F.max("toxic").alias("wanted")))
    marks = bitmap(picked, "doc_id", picked.count())
    of = maybe_in(own, F.col("doc_id"), marks).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # an id that was picked as unlabelled but has a label beyond the labelled sample stays out
    chosen = written(picked.join(of, "doc_id", "left").filter(F.col("wanted") | F.col("toxic").isNull()).select("doc_id", "toxic"))
    rows = maybe_in(train, F.col("doc_id"), marks).join(chosen, "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.max("toxic").alias("toxic"), F.any_value("text").alias("text")))


def voters(held: Sparse, strength: np.ndarray, shape: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A column of votes a voter: induced lexica, the fixed list, address, and the patterns of marks and capitals.

    Entries that point to the label are dealt to voters; one that finds none of its entries votes against.
    """
    strong = np.flatnonzero(strength > SURE)
    votes = [np.where(held.any_of(strong[k::VOTERS]), 1, -1) for k in range(min(VOTERS, len(strong)))]
    votes += [np.where(shape[:, 4] > 0, 1, 0), np.where(shape[:, 3] > centre[3] + 2 * scale[3], 1, 0)]
    votes += [np.where(shape[:, k] > centre[k] + 2 * scale[k], 1, 0) for k in range(3)]
    return np.stack(votes, axis=1).astype(np.int8)


FITTED = "weights array<double>, shape array<double>, centre array<double>, scale array<double>, bias double, rates array<double>"


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The scoring model. Without usable labels of both kinds it scores by the fixed list alone.

    Rows that repeat an id or a text count once. Features are made where the rows are; one task fits them (at most two
    `sample`s of short rows), and a lost one is run again with the same rows in the same order.
    """
    rows = sample_rows(docs, labels, id_col, text_col, sample)
    marked = rows.filter("toxic IS NOT NULL")
    prior = marked.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, ones = prior["n"], prior["toxic"] or 0.0
    if not n or not 0 < ones < n:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(PATTERNS), np.ones(PATTERNS), np.array([0.0] * (PATTERNS - 1) + [40.0]), -3.0, np.zeros((0, 2)))
    counts = entry_counts(marked).filter(F.col("docs") >= LEAST)
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    lift = F.log(a / (ones + 1)) - F.log(b / (n - ones + 1))
    chi = (F.col("toxic") / ones - (F.col("docs") - F.col("toxic")) / (n - ones)) / F.sqrt(F.col("docs") / n * (1.001 - F.col("docs") / n))
    top = counts.withColumn("chi", chi).filter(lift > LIFT).orderBy(F.col("chi").desc(), "hash").limit(ENTRIES).collect()
    known = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    strength = np.array([r["toxic"] / (r["docs"] + 1) for r in top])
    order = np.argsort(known)
    known, strength = known[order], strength[order]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(known)
        for batch in batches:
            for lo, hi, raw, words in _texts(batch["text"]):
                doc, at = find(words)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].slice(lo, hi - lo), batch["toxic"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32))), pa.array(list(patterns(raw, words)), pa.list_(pa.float64()))],
                    names=["key", "toxic", "held", "shape"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        gold = np.concatenate([x["toxic"].to_numpy(zero_copy_only=False) for x in every]).astype(np.float64)
        sizes = np.concatenate([x["held"].value_lengths().to_numpy() for x in every])
        held = Sparse(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x["held"].flatten().to_numpy() for x in every]), len(known))
        shape = np.concatenate([x["shape"].flatten().to_numpy() for x in every]).reshape(-1, PATTERNS)
        del every
        centre, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-9
        post, rates, _ = label_model(voters(held, strength, shape, centre, scale), gold, float(np.clip(ones / n, 0.01, 0.99)))
        w, bias = logistic(held, ((shape - centre) / scale).clip(-3, 3), post)
        found = [w[: len(known)], w[len(known) :], centre, scale]
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tolist()], pa.list_(pa.float64())) for x in found), pa.array([bias]), pa.array([rates.ravel().tolist()], pa.list_(pa.float64()))], names=["weights", "shape", "centre", "scale", "bias", "rates"])

    made = rows.mapInArrow(features, "key string, toxic double, held array<int>, shape array<double>")
    r = made.repartition(1).sortWithinPartitions("key").mapInArrow(train, FITTED).first()
    return Model(known, *(np.array(r[c]) for c in ("weights", "centre", "scale", "shape")), r["bias"], np.array(r["rates"]).reshape(-1, 2))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1, of every text. Null and empty texts hold no entry and get the score of their absence.

    Rows stand alone: rows that repeat an id each get the score of their own text.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model.known)
        for batch in batches:
            for lo, hi, raw, words in _texts(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(_scores(model, find, raw, words))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """The documents, columns as they came, whose score is below the limit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model.known)
        for batch in batches:
            for lo, hi, raw, words in _texts(batch[text_col]):
                yield batch.slice(lo, hi - lo).filter(pa.array(_scores(model, find, raw, words) < limit))

    return docs.mapInArrow(work, docs.schema)


def _scores(model: Model, find: Finder, raw: np.ndarray, words: Words) -> np.ndarray:
    doc, at = find(words)
    total = np.bincount(doc, model.weights[at], minlength=words.docs) if len(at) else np.zeros(words.docs)
    shape = ((patterns(raw, words) - model.centre) / model.scale).clip(-3, 3)
    return 1 / (1 + np.exp(-np.clip(total + shape @ model.shape + model.bias, -30, 30)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
