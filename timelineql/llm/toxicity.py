"""Toxicity by lexicon induction: labelled seed terms, a positive-PMI word graph, random walks, and a polarity lexicon.

1. All labelled documents give seed terms: words of at least SEED_DOCS toxic documents whose share of toxic documents is SEED_RATIO times that of clean ones, with
   a log-likelihood ratio beyond that of chance among as many words as could pass (the universal threshold 2 ln V). Words of a clean document that aren't
   SEED_RATIO times as frequent in toxic ones are neutral; all other words are undecided. Near copies count once, so that one much-copied document makes no seeds.
2. The graph's words are all words of the corpus. Edges are positive PMI of documents where at least three documents have both words and their log-likelihood
   ratio is also beyond that of chance among the words of three documents or more (2 ln V). Each word is linked to its NEIGHBOURS nearest; toxic and undecided words only if each is among the other's.
3. A walk from an undecided word ends at the first toxic or neutral word, or at any step with probability RESTART. Polarity in -1..1 compares the shares
   of walks that end at toxic and at neutral words; seeds have 1 and -1.
4. Only words with a path of undecided words to a toxic seed can have a positive polarity. The neighbours of the seeds are counted, then those of the words
   that these reach, and so on as far as that goes, each time over the whole corpus: the lexicon is that of the whole graph, and the rest of it needs no counting.
   The walks are on the driver while the edges they use are at most DRIVER_EDGES, and joins over tables beyond that, with the same result.
5. A document's score is the sum of the positive polarities of its distinct words; the labelled documents set the threshold.

Defined results: null and empty texts score 0 and are not toxic, and an empty table has no rows; without labels of both classes, or without seeds, nothing is
toxic. Repeated rows are scored alike. doc_id may be null. Whole texts are read, of any length. Ties: neighbours whose PMI ties with the last are all kept,
and of thresholds that tie the highest is taken. Other columns, of whatever names, are kept by the pipeline's stage and not read.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, table
from .near_dedup import shingles

_libc = ctypes.CDLL(None)
SEED_DOCS, SEED_RATIO = 3, 8.0
DRIVER_EDGES, BROADCAST = 20_000_000, 1_000_000
ROUNDS = 60
PAIRS_AT_ONCE = 500_000
#: Rows and bytes of text that a task works through at once; they change no result.
ROWS, BLOCK = 500, 1 << 19
RESTART = 0.15
NEIGHBOURS = 5
STRONG = 0.5
#: Of a graph of few words only, by whose brute-force version a test also holds the whole one, on texts where both have the same lexicon.
NEUTRAL, NEUTRAL_SHARES = 60, (0.02, 0.10)
BESIDE, CONFIDENCE = 0.8, 1.645


def _blocks(column):
    """K.blocks, with the copies it makes being of ROWS rows instead of a whole batch."""
    for r0 in range(0, len(column), ROWS):
        for a, data, offsets in K.blocks(column.slice(r0, ROWS), limit=BLOCK):
            yield r0 + a, data, offsets


def _freed() -> None:
    """Gives the worker's free memory back, which the next task's batches would come on top of."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def _distinct(data, offsets):
    """Word hashes of a block, each once a row, with their rows."""
    h, _, _, o = K.words(data, offsets)
    r = K.row_of(o)
    keep = np.unique(h ^ K.mix(r.astype(np.uint64)), return_index=True)[1]
    keep.sort()
    return h[keep], r[keep]


def _clusters(data, offsets) -> np.ndarray:
    """For each row two minima over pairs of words: most near copies share them."""
    pairs, start = shingles(data, offsets, 2)
    full = np.flatnonzero(np.diff(start))
    cluster = np.zeros(len(offsets) - 1, np.uint64)
    if len(full):
        for seed in (1, 2):
            low = np.minimum.reduceat(K.mix(pairs + np.uint64(seed)), start[full])
            cluster[full] = K.mix(cluster[full] ^ low)
    return cluster


def _labelled(batches):
    for batch in batches:
        for a, data, offsets in _blocks(batch.column("text")):
            part = batch.slice(a, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(K.signed(_clusters(data, offsets)))], ["doc_id", "toxic", "cluster"])
    _freed()


COUNTED = "cluster long, word long, n long, n1 long, n0 long"


def _counts(batches):
    """Counts (null, word, documents, toxic and clean ones), added up within the task, and in the row of the null word the documents. Labelled documents whose
    doc_id is repeated are left out of the last two, and have a row (cluster, word, 0, n1, n0) for each word."""
    rows, parts = 0, []

    def table_of(cluster, word, *counts):
        return pa.RecordBatch.from_arrays([cluster, word, *(pa.array(c.astype(np.int64)) for c in counts)], ["cluster", "word", "n", "n1", "n0"])

    def merged():
        u, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        return u, *(np.bincount(at, weights=np.concatenate([x[k] for x in parts]), minlength=len(u)) for k in (1, 2, 3))

    def out():
        u, n, n1, n0 = merged()
        return table_of(pa.nulls(len(u), pa.int64()), pa.array(K.signed(u)), n, n1, n0)

    for batch in batches:
        toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
        alone = batch.column("alone").fill_null(False).to_numpy(zero_copy_only=False)
        for a, data, offsets in _blocks(batch.column("text")):
            h, r = _distinct(data, offsets)
            u, at = np.unique(h, return_inverse=True)
            parts.append((u, np.bincount(at, minlength=len(u)), *(np.bincount(at, weights=(alone & (toxic == c))[a + r], minlength=len(u)) for c in (1, 0))))
            rows += len(offsets) - 1
            if sum(len(x[0]) for x in parts) > 500_000:
                parts = [merged()]
                if len(parts[0][0]) > 250_000:
                    yield out()
                    parts = []
        copied = (toxic >= 0) & ~alone
        if copied.any():
            c = toxic[copied]
            for a, data, offsets in _blocks(batch.column("text").filter(pa.array(copied))):
                h, r = _distinct(data, offsets)
                yield table_of(pa.array(K.signed(_clusters(data, offsets)[r])), pa.array(K.signed(h)), np.zeros(len(h)), c[a + r] == 1, c[a + r] == 0)
    if parts:
        yield out()
    yield table_of(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), np.array([rows]), np.zeros(1), np.zeros(1))
    _freed()


class Vocabulary:
    """Finds sorted 64-bit hashes fast: a table over their first 16 bits turns most words away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.first = np.zeros(1 << 16, bool)
        self.first[self.hashes >> np.uint64(48)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which elements are in the vocabulary, and their places in it."""
        at = np.flatnonzero(self.first[h >> np.uint64(48)])
        if not len(self.hashes):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == h[at]
        return at[ok], place[ok]


def _pairs(words):
    """(of, to, n): the documents of the task that a word of these, by its place, shares with any other word, by its hash."""

    def run(batches):
        vocabulary, parts = Vocabulary(words.value), []

        def merged():
            of, to, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((to, of))
            of, to, n = of[order], to[order], n[order]
            first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (to[1:] != to[:-1])))
            return of[first], to[first], np.add.reduceat(n, first)

        def out():
            of, to, n = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(of), pa.array(K.signed(to)), pa.array(n)], ["of", "to", "n"])

        for batch in batches:
            for _, data, offsets in _blocks(batch.column("text")):
                h, r = _distinct(data, offsets)
                at, place = vocabulary.find(h)
                if not len(at):
                    continue
                start = np.searchsorted(r, r[at])
                size = np.searchsorted(r, r[at], "right") - start
                u, number = np.unique(h, return_inverse=True)
                total, a = np.cumsum(size), 0
                while a < len(at):
                    b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + PAIRS_AT_ONCE, "right")))
                    first = np.repeat(np.arange(a, b), size[a:b])
                    second = start[first] + np.arange(len(first)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
                    other = second != at[first]
                    key, n = np.unique(place[first[other]] * len(u) + number[second[other]], return_counts=True)
                    parts.append((key // len(u), u[key % len(u)], n))
                    if sum(len(x[0]) for x in parts) > PAIRS_AT_ONCE:
                        parts = [merged()]
                        if len(parts[0][0]) > PAIRS_AT_ONCE // 2:
                            yield out()
                            parts = []
                    a = b
        if parts:
            parts = [merged()]
            yield out()
        _freed()

    return run


def nearest(counted: DataFrame, asked: DataFrame, frequency: DataFrame, documents: int, testable: int) -> DataFrame:
    """(of, to, weight) of each word's nearest, from rows (of, to, n) that may come in parts, the words asked for (of, n_of), and the frequencies (word, n) of the
    testable words, those of three documents or more: positive PMI with a log-likelihood ratio beyond that of chance among as many words."""
    least = float(2 * np.log(max(testable, 2)))
    pairs = counted.groupBy("of", "to").agg(F.sum("n").alias("n")).where("n >= 3").join(asked, "of")
    pairs = pairs.join(frequency.select(F.col("word").alias("to"), F.col("n").cast("double").alias("n_to")), "to")
    pairs = pairs.withColumn("expected", F.col("n_of") * F.col("n_to") / documents)
    pmi = F.log(F.col("n") / F.col("expected"))
    strong = pairs.where((F.col("n") > F.col("expected")) & (2 * (F.col("n") * pmi - F.col("n") + F.col("expected")) >= least)).select("of", "to", pmi.alias("weight"))
    return strong.withColumn("rank", F.rank().over(Window.partitionBy("of").orderBy(F.desc("weight")))).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def seed_words(counts: DataFrame, t1: int, t0: int, testable: int) -> tuple[DataFrame, DataFrame]:
    """From (word, n1, n0), the toxic and clean documents with a word of t1 and t0: the toxic seeds (word), and the counts with whether labels show a word to be neutral."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    ratio = ((n1 + 0.5) / (t1 + 1)) / ((n0 + 0.5) / (t0 + 1))
    all_ = float(t1 + t0)

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    g = 2 * (term(n1, (n1 + n0) * t1 / all_) + term(n0, (n1 + n0) * t0 / all_) + term(t1 - n1, (all_ - n1 - n0) * t1 / all_) + term(t0 - n0, (all_ - n1 - n0) * t0 / all_))
    toxic = counts.where((n1 >= SEED_DOCS) & (ratio >= SEED_RATIO) & (g >= 2 * np.log(max(testable, 2)))).select("word")
    return toxic, counts.withColumn("neutral", (n0 >= 1) & (ratio < SEED_RATIO))


def walk(a: np.ndarray, b: np.ndarray, weight: np.ndarray, toxic: np.ndarray, neutral: np.ndarray) -> np.ndarray:
    """Polarities of all words from undirected edges; toxic and neutral mark the words where walks end."""
    n = len(toxic)
    of, to, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    step = w / np.bincount(of, weights=w, minlength=n)[of]

    def ends(at, elsewhere):
        p = at.astype(float)
        for _ in range(ROUNDS):
            p = np.where(at, 1.0, np.where(elsewhere, 0.0, (1 - RESTART) * np.bincount(of, weights=p[to] * step, minlength=n)))
        return p

    x, y = ends(toxic, neutral), ends(neutral, toxic)
    return np.divide(x - y, x + y, out=np.zeros_like(x), where=x + y > 0)


def walk_tables(spark: SparkSession, edges: DataFrame, toxic: np.ndarray, neutral: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The same polarities by joins, for graphs too large for the driver's arrays; only the words' own arrays are there."""
    both = edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), "weight")).toDF("of", "to", "weight")
    step = both.join(both.groupBy("of").agg(F.sum("weight").alias("size")), "of")
    step = scratch.save(step.select("of", "to", (F.col("weight") / F.col("size")).alias("step")), "step")
    starts = spark.createDataFrame(pa.table({"node": np.arange(len(toxic)), "x0": toxic.astype(float), "y0": neutral.astype(float)}))
    now = starts.select("node", F.col("x0").alias("x"), F.col("y0").alias("y"))
    for k in range(ROUNDS):
        come = step.join(now.withColumnRenamed("node", "to"), "to").groupBy("of").agg(F.sum(F.col("x") * F.col("step")).alias("x"), F.sum(F.col("y") * F.col("step")).alias("y"))
        then = starts.join(come.withColumnRenamed("of", "node"), "node", "left")
        ended = F.col("x0") + F.col("y0") > 0
        now = then.select("node", *[F.when(ended, F.col(f"{c}0")).otherwise((1 - RESTART) * F.coalesce(c, F.lit(0.0))).alias(c) for c in "xy"])
        now = scratch.save(now, f"walk{k}")
        if k:
            scratch.drop(f"walk{k - 1}")
    out = np.zeros(len(toxic))
    t = now.select("node", F.when(F.col("x") + F.col("y") > 0, (F.col("x") - F.col("y")) / (F.col("x") + F.col("y"))).otherwise(0.0).alias("polarity")).toArrow()
    out[t.column("node").to_numpy()] = t.column("polarity").to_numpy()
    return out


def reach(toxic: np.ndarray, lists_of):
    """(words, a, b, weight, toxic, neutral): the part of the whole graph where walks can end at a toxic word. lists_of gives the nearest
    (of, to, weight, neutral) of words; it is asked for those of the seeds, then of the undecided words near what is reached, until there are no others."""
    toxic = np.sort(toxic)
    parts, known, ask = [], toxic[:0], toxic
    while len(ask):
        parts.append(lists_of(ask))
        known = np.union1d(known, ask)
        of, to, weight, neutral = (np.concatenate(x) for x in zip(*parts))
        words, at = np.unique(np.concatenate([of, to, toxic]), return_inverse=True)
        i, j = at[: len(of)], at[len(of) : 2 * len(of)]
        is_toxic, is_neutral = np.isin(words, toxic), np.zeros(len(words), bool)
        is_neutral[j] = neutral
        is_neutral &= ~is_toxic
        mutual = np.isin(i * len(words) + j, j * len(words) + i)
        reached, more = is_toxic.copy(), True
        while more:
            new = j[mutual & reached[i] & ~reached[j] & ~is_neutral[j]]
            more = len(new) > 0
            reached[new] = True
        near = np.zeros(len(words), bool)
        near[j[reached[i]]] = True
        ask = np.setdiff1d(words[near & ~is_neutral], known)
    edge = reached[i] & ((mutual & reached[j] & (i < j)) | (is_neutral[j] & ~is_toxic[i]))
    return words, i[edge], j[edge], weight[edge], is_toxic, is_neutral


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap whose lower end has the best F1 on the sample; a tie takes the highest."""
    if not toxic.any():
        return float("inf")
    values, at = np.unique(scores, return_inverse=True)
    hits = np.cumsum(np.bincount(at)[::-1])[::-1]
    right = np.cumsum(np.bincount(at, weights=toxic)[::-1])[::-1]
    f1 = np.where(values > 0, 2 * right / np.maximum(1, hits + toxic.sum()), -1.0)
    best = len(values) - 1 - int(np.argmax(f1[::-1]))
    if values[best] <= 0:
        return float("inf")
    return float((max(values[best - 1] if best else -1.0, 0.0) + values[best]) / 2)


def induce(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None):
    """(hashes, weights, threshold): the lexicon of positive words, sorted by hash."""
    scratch = scratch or Scratch(spark)
    docs = docs.select("doc_id", "text")
    send = lambda df, rows: F.broadcast(df) if rows <= BROADCAST else df
    labelled = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = scratch.save(docs.join(send(labelled, labels.count()), "doc_id").mapInArrow(_labelled, "doc_id long, toxic int, cluster long"), "labelled")
    t = {r["toxic"]: r["n"] for r in some.groupBy("toxic").agg(F.countDistinct("cluster").alias("n")).collect()}
    nothing = np.zeros(0, np.uint64), np.zeros(0), float("inf")
    if len(t) < 2:
        return nothing
    first = some.groupBy("toxic", "cluster").agg(F.min("doc_id").alias("doc_id"))  # of near copies of a class the lowest doc_id counts
    marks = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), (F.count("*") == 1).alias("alone")).join(first.select("doc_id").distinct().withColumn("first", F.lit(True)), "doc_id", "left")
    marks = scratch.save(marks, "marks")
    marked = send(marks, marks.count())
    counting = marked.where("first").select("doc_id", "toxic", "alone")
    counted = docs.join(counting, "doc_id", "left").select("text", "toxic", "alone").mapInArrow(_counts, COUNTED)
    counted = scratch.save(counted.groupBy("cluster", "word").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n0")]), "counted")
    documents = counted.where("word is null").collect()[0]["n"]
    counts = counted.where("cluster is null and word is not null").drop("cluster")
    copied = counted.where("cluster is not null").select("word", "n", F.least("n1", F.lit(1)).alias("n1"), F.least("n0", F.lit(1)).alias("n0"))
    if not copied.isEmpty():
        counts = scratch.save(counts.union(copied).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n0")]), "words")
    toxic, counts = seed_words(counts, t[1], t[0], counts.where(F.col("n1") >= SEED_DOCS).count())
    toxic = toxic.toArrow().column("word").to_numpy().view(np.uint64)
    scratch.drop("labelled")
    if not len(toxic):
        scratch.drop()
        return nothing
    frequency = counts.where("n >= 3")
    testable = frequency.count()

    def lists_of(words):
        pairs = docs.select("text").mapInArrow(_pairs(spark.sparkContext.broadcast(words)), "of long, to long, n long")
        asked = send(spark.createDataFrame(pa.table({"of": np.arange(len(words)), "word": K.signed(words)})), len(words))
        asked = send(frequency.join(asked, "word").select("of", F.col("n").cast("double").alias("n_of")), len(words))
        found = nearest(pairs, asked, frequency, documents, testable).join(counts.select(F.col("word").alias("to"), "neutral"), "to")
        got = found.select("of", "to", "weight", "neutral").toArrow()
        of, to = words[got.column("of").to_numpy()], got.column("to").to_numpy().view(np.uint64)
        return of, to, got.column("weight").to_numpy(), got.column("neutral").to_numpy()

    words, a, b, weight, is_toxic, is_neutral = reach(toxic, lists_of)
    if len(a) <= DRIVER_EDGES:
        polarity = walk(a, b, weight, is_toxic, is_neutral)
    else:
        polarity = walk_tables(spark, spark.createDataFrame(pa.table({"a": a, "b": b, "weight": weight})), is_toxic, is_neutral, scratch)
    strong = np.round(polarity, 9) >= STRONG
    hashes, weights = words[strong], np.round(polarity[strong], 9)
    scored = _scored(docs.join(marked.select("doc_id", "toxic"), "doc_id"), hashes, weights)
    got = scored.groupBy("toxic", "score").count().toArrow()
    scores, is_bad = (np.repeat(got.column(c).to_numpy(), got.column("count").to_numpy()) for c in ("score", "toxic"))
    threshold = best_threshold(scores, is_bad == 1)
    scratch.drop()
    return hashes, weights, threshold


def _scores(column, vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(column))
    for a, data, offsets in _blocks(column):
        h, _, _, o = K.words(data, offsets)
        at, place = vocabulary.find(h)
        n = len(vocabulary.hashes)
        seen = np.unique(K.row_of(o)[at] * n + place)
        out[a : a + len(offsets) - 1] = np.bincount(seen // n, weights=weights[seen % n], minlength=len(offsets) - 1) if n else 0
    return np.round(out, 6)


def _scored(docs: DataFrame, hashes: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(toxic, score) of labelled documents."""

    def run(batches):
        vocabulary = Vocabulary(hashes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(_scores(batch.column("text"), vocabulary, weights))], ["toxic", "score"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, score double")


def score(docs: DataFrame, hashes: np.ndarray, weights: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, score and whether it reaches the threshold, for all rows."""

    def run(batches):
        vocabulary = Vocabulary(hashes)
        for batch in batches:
            s = _scores(batch.column("text"), vocabulary, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(s >= threshold)], ["doc_id", "score", "is_toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, is_toxic boolean")


def without_toxic(docs: DataFrame, hashes: np.ndarray, weights: np.ndarray, threshold: float) -> DataFrame:
    """All columns of the documents that don't reach the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        vocabulary = Vocabulary(hashes)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield part.filter(pa.array(_scores(part.column(at), vocabulary, weights) < threshold))
        _freed()

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *induce(spark, docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the lexicon rejects."""
    return without_toxic(docs, *induce(spark, docs, table(spark, sf_dir, "labels")))
