import math
import random

import numpy as np
import pytest

from timelineql.llm import kernel as K
from timelineql.llm import toxicity as X

BAD = ["vile", "scum", "idiot", "moron", "trash"]
MILD = ["garden", "river", "music", "table", "letter", "window", "stone", "paper", "cloud", "silver"]


@pytest.fixture(scope="module")
def corpus(spark, make):
    rng = random.Random(3)
    rows, labels = [], []
    common = [f"w{i}" for i in range(40)]
    for i in range(600):
        toxic = i % 6 == 0
        words = rng.choices(common, k=40) + rng.sample(MILD, 3) + (rng.sample(BAD, 3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_finds_toxic_documents_and_no_others(spark, corpus):
    docs, labels = corpus
    found = X.score(docs, *X.induce(spark, docs, labels)).collect()
    assert {r["doc_id"] for r in found if r["is_toxic"]} == set(range(0, 600, 6))
    assert len(found) == 600


def test_induces_words_that_labels_do_not_show(spark, corpus):
    """The lexicon has a word that only unlabelled toxic documents use."""
    docs, labels = corpus
    from pyspark.sql import functions as F

    hidden = docs.withColumn("text", F.when((F.col("doc_id") % 6 == 0) & (F.col("doc_id") % 4 != 0), F.concat("text", F.lit(" zounds"))).otherwise(F.col("text")))
    few = labels.where("toxic = 0 or doc_id % 4 = 0")
    hashes, weights, _ = X.induce(spark, hidden, few)
    assert K.word_hash("zounds") in hashes.tolist() and K.word_hash("w1") not in hashes.tolist()
    assert (weights > 0).all()


def test_scores_match_brute_force(spark, corpus):
    docs, _ = corpus
    words = ["w1", "river", "scum"]
    h = np.array([K.word_hash(w) for w in words], np.uint64)
    order = np.argsort(h)
    w = np.array([0.5, 0.25, 1.0])
    got = {r["doc_id"]: r["score"] for r in X.score(docs, h[order], w[order], 1.0).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(sum(x for t, x in zip(words, w) if t in r["text"].split()))


def test_odd_rows(spark, odd, none, corpus):
    labels = corpus[1]
    for docs in (odd, none):
        lexicon = X.induce(spark, docs, labels)
        assert X.score(docs, *lexicon).where("is_toxic").count() == 0
        kept = X.without_toxic(docs, *lexicon)
        assert kept.columns == docs.columns and kept.count() == docs.count()
    empty = labels.where("false")
    assert X.score(corpus[0], *X.induce(spark, corpus[0], empty)).where("is_toxic").count() == 0


def brute(texts, toxic_of):
    """The lexicon and threshold by dense matrices and loops over words; texts of whole words, of which no two are near copies."""
    sets = {i: set(t.split()) for i, t in texts.items()}
    vocabulary = sorted(set().union(*sets.values()))
    bad, good = [i for i, t in toxic_of.items() if t], [i for i, t in toxic_of.items() if not t]
    n1 = {w: sum(w in sets[i] for i in bad) for w in vocabulary}
    n0 = {w: sum(w in sets[i] for i in good) for w in vocabulary}
    t1, t0 = len(bad), len(good)
    testable = sum(n1[w] >= X.SEED_DOCS for w in vocabulary)

    def g(w):
        table = [(n1[w], n0[w]), (t1 - n1[w], t0 - n0[w])]
        return 2 * sum(o * math.log(o / (sum(row) * t / (t1 + t0))) for row in table for o, t in zip(row, (t1, t0)) if o)

    ratio = {w: (n1[w] + 0.5) / (t1 + 1) / ((n0[w] + 0.5) / (t0 + 1)) for w in vocabulary}
    seeds = {w for w in vocabulary if n1[w] >= X.SEED_DOCS and ratio[w] >= X.SEED_RATIO and g(w) >= 2 * math.log(testable)}
    calm = [w for w in vocabulary if ratio[w] <= 1 and X.NEUTRAL_SHARES[0] * t0 <= n0[w] <= X.NEUTRAL_SHARES[1] * t0]
    calm = set(sorted(calm, key=lambda w: (-n0[w], np.uint64(K.word_hash(w)).view(np.int64)))[: X.NEUTRAL])
    df = {w: sum(w in s for s in sets.values()) for w in vocabulary}
    beside = {w: sum(w in s and bool(s & seeds) for s in sets.values()) for w in vocabulary}

    def wilson(k, n, z=X.CONFIDENCE):
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    nodes = [w for w in vocabulary if w in seeds or w in calm or wilson(beside[w], df[w]) >= X.BESIDE]
    m = np.array([[w in s for w in nodes] for s in sets.values()], float)
    c = m.T @ m
    e = np.outer(np.diag(c), np.diag(c)) / len(sets)
    with np.errstate(divide="ignore"):
        p = np.where((c > e) & (c >= 3) & (c >= e + 3 * np.sqrt(e)), np.log(c / e), 0)
    np.fill_diagonal(p, 0)
    near = np.array([[x > 0 and (row > x).sum() < X.NEIGHBOURS for x in row] for row in p])
    p = p * (near & near.T)
    size = np.sqrt(p.sum(1))
    step = np.divide(p, np.outer(size, size), out=np.zeros_like(p), where=np.outer(size, size) > 0)
    masses = []
    for start in (seeds, calm):
        s = np.array([w in start for w in nodes], float)
        s /= max(1, s.sum())
        x = s
        for _ in range(X.ROUNDS):
            x = (1 - X.RESTART) * (step.T @ x) + X.RESTART * s
        masses.append(x)
    x, y = masses
    polarity = np.divide(x - y, x + y, out=np.zeros_like(x), where=x + y > 0)
    lexicon = {w: round(v, 9) for w, v in zip(nodes, polarity) if round(v, 9) >= X.STRONG}
    score = {i: round(sum(v for w, v in lexicon.items() if w in sets[i]), 6) for i in toxic_of}
    best, at = -1.0, math.inf
    values = sorted(set(score.values()))
    for low, high in zip([0.0, *values], values):
        if high > 0:
            hit = {i for i in score if score[i] >= high}
            f1 = 2 * len(hit & set(bad)) / (len(hit) + len(bad))
            if f1 >= best:
                best, at = f1, (max(low, 0.0) + high) / 2
    return lexicon, at


def test_induction_against_brute_force(spark, make):
    """Seeds, document frequencies, co-occurrence, PPMI, neighbours, walks and threshold, from texts on; also with the walks by joins."""
    rng = random.Random(12)
    texts, toxic_of = {}, {}
    topic = [[f"t{k}x{i}" for i in range(12)] for k in range(6)]
    for i in range(700):
        toxic = i % 5 == 0
        words = [f"w{int(rng.paretovariate(0.8)) % 900}" for _ in range(30)] + rng.sample(topic[i % 6], 3)
        words += rng.sample([*BAD, "zounds", "oaf"], 3) if toxic else rng.sample(BAD, 1) * (rng.random() < 0.03)
        rng.shuffle(words)
        texts[i] = " ".join(words)
        if i % 2 == 0:
            toxic_of[i] = int(toxic)
    docs = make(list(texts.items()))
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic_of.items()], "doc_id long, quality int, toxic int")
    lexicon, threshold = brute(texts, toxic_of)
    assert len(lexicon) >= 5
    for limit in (X.DRIVER_EDGES, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(X, "DRIVER_EDGES", limit)
            if not limit:
                m.setattr(X, "ROUNDS", 5)
                lexicon, threshold = brute(texts, toxic_of)
            hashes, weights, at = X.induce(spark, docs, labels)
        got = dict(zip(hashes.tolist(), weights.tolist()))
        assert set(got) == {K.word_hash(w) for w in lexicon}
        assert all(got[K.word_hash(w)] == pytest.approx(v, abs=1e-8) for w, v in lexicon.items()) and at == pytest.approx(threshold, abs=1e-5)


def test_walk_separates_two_cliques():
    a, b = np.array([0, 0, 1, 3, 3, 4, 2]), np.array([1, 2, 2, 4, 5, 5, 3])
    p = X.walk(a, b, np.array([1.0] * 6 + [0.01]), np.array([1, 0, 0, 0, 0, 0], bool), np.array([0, 0, 0, 1, 0, 0], bool))
    assert (p[:3] > 0.9).all() and (p[3:] < -0.9).all()


def test_thresholds_of_a_full_search():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores, bad = rng.integers(0, 6, 30) / 2, rng.random(30) < 0.3
        best, at = -1.0, np.inf
        for high in np.unique(scores):
            low = scores[scores < high].max(initial=0.0)
            f1 = 2 * ((scores >= high) & bad).sum() / max(1, (scores >= high).sum() + bad.sum())
            if high > 0 and bad.any() and f1 >= best:
                best, at = f1, (low + high) / 2
        assert X.best_threshold(scores, bad) == at


def whole(texts, toxic_of):
    """The lexicon of the graph of all words, dense, with walks over all of it; texts of whole words, of which no two are near copies."""
    sets = {i: set(t.split()) for i, t in texts.items()}
    words = sorted(set().union(*sets.values()))
    held = np.array([[w in s for w in words] for s in sets.values()], float)
    label = np.array([toxic_of.get(i, -1) for i in sets])
    t1, t0 = (label == 1).sum(), (label == 0).sum()
    n1, n0 = held[label == 1].sum(0), held[label == 0].sum(0)

    def g(k1, k0):
        rows = [(k1, k0), (t1 - k1, t0 - k0)]
        return 2 * sum(o * math.log(o / (sum(row) * t / (t1 + t0))) for row in rows for o, t in zip(row, (t1, t0)) if o)

    ratio = (n1 + 0.5) / (t1 + 1) / ((n0 + 0.5) / (t0 + 1))
    enough = 2 * math.log((n1 >= X.SEED_DOCS).sum())
    toxic = np.array([a >= X.SEED_DOCS and r >= X.SEED_RATIO and g(a, b) >= enough for a, b, r in zip(n1, n0, ratio)])
    neutral = (n0 >= 1) & (ratio < X.SEED_RATIO)
    c = held.T @ held
    df = np.diag(c)
    e = np.outer(df, df) / len(sets)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.where((c >= 3) & (c > e) & (2 * (c * np.log(c / e) - c + e) >= 2 * math.log((df >= 3).sum())), np.log(c / e), 0)
    np.fill_diagonal(pmi, 0)
    near = np.array([[x > 0 and (row > x).sum() < X.NEIGHBOURS for x in row] for row in pmi])
    pmi = pmi * near * (near.T | (neutral & ~toxic)[None])
    size = pmi.sum(1, keepdims=True)
    step = np.divide(pmi, size, out=np.zeros_like(pmi), where=size > 0)
    x, y = toxic * 1.0, neutral * 1.0
    for _ in range(X.ROUNDS):
        x = np.where(toxic, 1, np.where(neutral, 0, (1 - X.RESTART) * step @ x))
        y = np.where(toxic, 0, np.where(neutral, 1, (1 - X.RESTART) * step @ y))
    polarity = np.divide(x - y, x + y, out=np.zeros_like(x), where=x + y > 0)
    return {w: v for w, v, on in zip(words, polarity, np.round(polarity, 9) >= X.STRONG) if on}, [w for w, t in zip(words, toxic) if t]


def test_the_graph_has_all_words(spark, make, monkeypatch):
    """An unlabelled word that stands beside seeds in half of its documents gets the polarity of the graph of all words."""
    rng = random.Random(5)
    texts, toxic_of = {}, {}
    for i in range(700):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(30)] + (rng.sample(BAD, 2) if toxic else [])
        if i % 20 == 5:
            words += ["vile"] * ("vile" not in words) + ["gadzooks"]
        if i % 20 == 7:
            words += ["gadzooks", "egad"]
        if i % 20 == 9:
            words += ["egad", "begorra", "w1"]
        rng.shuffle(words)
        texts[i] = " ".join(words)
        if i % 20 not in (5, 7, 9):
            toxic_of[i] = int(toxic)
    lexicon, seeds = whole(texts, toxic_of)
    assert "gadzooks" in set(lexicon) - set(seeds)
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic_of.items()], "doc_id long, quality int, toxic int")
    for limit in (X.DRIVER_EDGES, 0):
        monkeypatch.setattr(X, "DRIVER_EDGES", limit)
        if not limit:
            monkeypatch.setattr(X, "ROUNDS", 5)
            lexicon, _ = whole(texts, toxic_of)
        hashes, weights, _ = X.induce(spark, make(list(texts.items())), labels)
        assert dict(zip(hashes.tolist(), weights.tolist())) == pytest.approx({K.word_hash(w): v for w, v in lexicon.items()}, abs=1e-8)


def test_passes_copy_few_rows_at_once(monkeypatch):
    """No pass lowers or hashes more than ROWS rows at a time, or hands on more; of rows cut so, scores and rows are those of single rows."""
    import pyarrow as pa

    most, blocks = [], K.blocks
    monkeypatch.setattr(K, "blocks", lambda column, **k: most.append(len(column)) or blocks(column, **k))
    texts = [None if i % 97 == 0 else f"w{i} scum" * (i % 3) for i in range(2 * X.ROWS + 7)]
    h, w = np.array([K.word_hash("scum")], np.uint64), np.array([1.0])
    got = X._scores(pa.array(texts), X.Vocabulary(h), w)
    assert got.tolist() == [float(t is not None and "scum" in t.split()) for t in texts]
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array([0] * len(texts), pa.int32()), pa.array([True] * len(texts))], ["doc_id", "text", "toxic", "alone"])
    assert sum(b.num_rows for b in X._labelled(iter([batch]))) == len(texts)
    assert [b for b in X._counts(iter([batch]))][-1].column("n").to_pylist() == [len(texts)]
    assert max(most) <= X.ROWS
