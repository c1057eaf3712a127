import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from timelineql.llm import kernel as K
from timelineql.llm import quality as Q


def prose(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(8, 30))).capitalize() + "."


def junk(rng):
    w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(20)]
    return rng.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 20), " ".join(x + "###" for x in w)])


def corpus(rng, n, at=0):
    rows, good = [], {}
    for i in range(at, at + n):
        good[i] = i % 3 > 0
        body = [prose(rng) for _ in range(rng.randint(2, 6))] if good[i] else [junk(rng) for _ in range(rng.randint(3, 6))] + [prose(rng)[:40]]
        rows.append((i, "\n".join(body)))
    return rows, good


def test_held_out_accuracy(spark, make):
    rng = random.Random(1)
    rows, good = corpus(rng, 300)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in good.items()], "doc_id long, quality int, toxic int")
    field = Q.fitted(spark, make(rows), labels)
    other, truth = corpus(rng, 200, 1000)
    got = {r["doc_id"]: r["is_retained"] for r in Q.labelled(make(other), field).collect()}
    assert sum(got[i] == g for i, g in truth.items()) >= 196


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(2)
    field = Q.Field(rng.normal(size=Q.FEATURES), rng.normal(size=(2, 2)), 0.3)
    codes = rng.integers(0, Q.FEATURES, (23, 8))
    o = np.array([0, 5, 5, 6, 16, 23])
    got = Q.viterbi(field, codes, o)
    e = field.scores(codes)

    def score(states, a):
        s = field.start * states[0] + sum(e[a + t] * x for t, x in enumerate(states))
        return s + sum(field.move[x, y] for x, y in zip(states, states[1:]))

    for a, b in zip(o[:-1], o[1:]):
        if b > a:
            best = max(itertools.product((0, 1), repeat=b - a), key=lambda s: score(s, a))
            assert got[a:b].tolist() == list(best)


def test_training_raises_the_likelihood_of_a_chain():
    rng = np.random.default_rng(3)
    labels = np.repeat(rng.integers(0, 2, 200), 5)
    codes = np.where(rng.random((1000, 8)) < 0.8, labels[:, None], 1 - labels[:, None])
    field = Q.train(codes, np.arange(0, 1001, 50), labels)
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]
    assert (Q.viterbi(field, codes, np.arange(0, 1001, 50)) == labels).mean() > 0.97


def test_line_features_of_blocks_and_odd_rows(spark, odd, none):
    texts = ["a b\nC!! D!!\n", "", None, "\n", "x"]
    parts = [Q.line_features(d, o) for _, d, o in K.blocks(pa.array(texts), lower=False)]
    assert [len(x[1]) for x in parts] == [4] and parts[0][1].tolist() == [3, 7, 0, 1] and parts[0][3].tolist() == [0, 2, 2, 2, 3, 4]
    for field in (None, Q.Field(np.zeros(Q.FEATURES), np.zeros((2, 2)), 0.0)):
        got = Q.labelled(odd, field).collect()
        assert len(got) == odd.count() and not any(r["is_retained"] for r in got if r["doc_id"] in (1, 2, 3, 5))
        assert all(r["is_retained"] for r in got if r["doc_id"] in (4, 6, 7, 9))
    assert Q.labelled(none, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fitted(spark, odd, labels) is None


def features(text):
    """The codes of each line, its bytes and words, by going through its characters."""
    out = []
    word = re.compile(rb"[^\x00-/:-@\[-`{-\x7f]+")
    raw = text.encode()
    lines = raw.split(b"\n")
    for k, line in enumerate(lines):
        if k == len(lines) - 1 and not line:
            break
        words = word.findall(line)
        inner = sum(65 <= c <= 90 and k > 0 and bool(word.fullmatch(line[k - 1 : k])) for k, c in enumerate(line))
        marks = sum(not word.fullmatch(bytes([c])) and c not in (9, 10, 11, 12, 13, 32, 124) for c in line)
        n, m = max(len(line), 1), max(len(words), 1)
        again = sum(a == b for a, b in zip(words, words[1:]))
        values = [inner / n, marks / m, sum(48 <= c <= 57 for c in line) / n, again / m, line.count(b"|") / n, sum(map(len, words)) / m, len(words)]
        code, base = [], 0
        for b, v in zip(Q.BINS, values):
            code.append(base + sum(v >= x for x in b))
            base += len(b) + 1
        code.append(base + (line[-1:] in (b".", b"!", b"?", b":", b";")))
        out.append((code, len(line), len(words)))
    return out


def test_features_labels_and_decoding_against_brute_force(spark, make):
    """The whole query on short texts: features by characters, the best of all sequences of states, and shares."""
    rng = random.Random(31)
    alphabet = ["a", "B", "cd cd", " ", "  ", "\n", "\n\n", "|", "!!", "é", "7", ".", "Word", "CAPS", ", ", "\t"]
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for i in range(150)}
    r = np.random.default_rng(5)
    field = Q.Field(r.normal(size=Q.FEATURES), r.normal(size=(2, 2)), 0.4)
    got = {x["doc_id"]: x for x in Q.labelled(make(list(texts.items())), field).collect()}
    for i, t in texts.items():
        lines = features(t)
        e = [sum(field.weights[c] for c in code) for code, _, _ in lines]
        best, states = -np.inf, ()
        for s in itertools.product((1, 0), repeat=len(lines)):
            v = sum(x * y for x, y in zip(e, s)) + sum(field.move[a, b] for a, b in zip(s, s[1:])) + (field.start * s[0] if s else 0)
            if v > best + 1e-12:
                best, states = v, s
        content = [x and w > 0 for x, (_, _, w) in zip(states, lines)]
        share = sum(n for x, (_, n, _) in zip(content, lines) if x) / max(1, sum(n for _, n, _ in lines))
        assert (got[i]["n_lines"], got[i]["n_content"]) == (len(lines), sum(content)) and got[i]["content_share"] == pytest.approx(share, abs=1e-6), t
        assert got[i]["is_retained"] == (round(share, 6) >= Q.KEEP and any(content))


def test_weak_labels_against_counts():
    rng = np.random.default_rng(6)
    codes, o, good = rng.integers(0, Q.FEATURES, (60, 8)), np.array([0, 10, 10, 25, 40, 60]), np.array([1, 0, 0, 1, 0])
    count = np.ones((2, Q.FEATURES))
    for d in range(5):
        for line in range(o[d], o[d + 1]):
            for c in codes[line]:
                count[good[d], c] += 1
    want = []
    for d in range(5):
        bad = [sum(np.log(count[1, c] / count[1].sum()) - np.log(count[0, c] / count[0].sum()) for c in codes[x]) < 0 for x in range(o[d], o[d + 1])]
        want += [1] * len(bad) if good[d] else [int(not b) for b in bad] if any(bad) else [0] * len(bad)
    assert Q.line_labels(codes, o, good).tolist() == want


def test_training_reaches_the_top_of_the_likelihood():
    """The conditional likelihood, summed over all sequences of states, can't be raised by a step in any direction of the field."""
    rng = np.random.default_rng(7)
    o = np.array([0, 4, 9, 12, 18])
    labels = rng.integers(0, 2, 18)
    codes = np.stack([np.where(rng.random(18) < 0.7, labels, 1 - labels), 2 + rng.integers(0, 3, 18)], 1)

    def likelihood(f):
        total = 0.0
        for a, b in zip(o[:-1], o[1:]):
            e = f.scores(codes[a:b])
            value = lambda s: sum(x * y for x, y in zip(e, s)) + sum(f.move[x, y] for x, y in zip(s, s[1:])) + f.start * s[0]
            total += value(labels[a:b]) - np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=b - a)))
        return total / 18 - Q.PENALTY / 2 * ((f.weights**2).sum() + (f.move**2).sum() + f.start**2)

    f = Q.train(codes, o, labels, steps=3000)
    top = likelihood(f)
    for k in range(12):
        step = rng.normal(size=(Q.FEATURES,)) * 0.3, rng.normal(size=(2, 2)) * 0.3, float(rng.normal()) * 0.3
        assert likelihood(Q.Field(f.weights + step[0], f.move + step[1], f.start + step[2])) <= top + 1e-4


def test_long_sequences_one_by_one(monkeypatch):
    rng = np.random.default_rng(8)
    field = Q.Field(np.round(rng.normal(size=Q.FEATURES), 1), np.round(rng.normal(size=(2, 2)), 1), 0.3)
    o = np.concatenate([[0], np.cumsum(rng.integers(0, 12, 40))])
    codes = rng.integers(0, Q.FEATURES, (o[-1], 8))
    want = Q.viterbi(field, codes, o)
    monkeypatch.setattr(Q, "LONG", 5)
    assert Q.viterbi(field, codes, o).tolist() == want.tolist()
    monkeypatch.setattr(Q, "LONG", 2000)
    import time

    began = time.process_time()
    assert len(Q.viterbi(field, rng.integers(0, Q.FEATURES, (500_000, 8)), np.array([0, 0, 500_000]))) == 500_000 and time.process_time() - began < 20
