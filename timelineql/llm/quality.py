"""Line sequence labelling: a linear-chain conditional random field marks each line content or boilerplate; the share of content decides.

1. A bounded sample of labelled documents (TRAIN rows of each class, the lowest hashes of doc_id) trains the field. Their lines' features are computed
   by the executors and sent as small codes. Labels are of documents, so lines get theirs first: all lines of good documents are content, and those of
   bad ones are boilerplate where their features are likelier in bad documents (all, where none is).
2. The field has binned features of each line, features of its neighbours' change through transitions, and a start; it is fitted by gradient steps on the
   exact conditional likelihood (forward-backward over all sampled sequences at once), with a penalty.
3. Every document of the table is labelled by Viterbi decoding, all sequences of a block at once, in one pass without a shuffle. It is retained
   if content lines hold at least KEEP of the characters (bytes, without the newlines) of its lines.

Defined results: null, empty and blank texts have no content (share 0) and aren't retained. Without labels of both classes every line with a word is content.
Repeated rows are labelled alike; doc_id may be null. Whole texts are labelled, with any number of lines; an empty table has no rows. Ties of states are content, and
of labels that a doc_id has more than one of the lower counts. Other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import table, workers_import

TRAIN, KEEP = 2_000, 0.5
STEPS, RATE, PENALTY = 150, 0.3, 1e-5
LONG = 2_000
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~K.WORD & ~_SPACE
_MARK[124] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;"]] = True
#: Bounds of the bins of each feature: share of capitals after a letter, marks but bars a word, share of digits, words that repeat the one before, share of bars,
#: mean word length, words.
BINS = [
    np.array([0.02, 0.15, 0.4]), np.array([0.02, 0.35, 1.2, 1.8]), np.array([0.02, 0.1, 0.3]), np.array([0.02, 0.1, 0.3]), np.array([1e-9, 0.02]),
    np.array([2.5, 4.0, 6.0, 9.0]), np.array([0.5, 8.5, 20.5, 60.5]),
]
_BASE = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS])])
FEATURES = int(_BASE[-1]) + 2


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of all rows: feature codes (lines, features), bytes, words; and the first line of each row (with the end)."""
    begins = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
    begins = begins[begins < len(data)] if len(data) else begins[:0]
    row = np.searchsorted(offsets, begins, "right") - 1
    ends = np.append(begins[1:], len(data))
    newline = np.zeros(len(begins), np.int64)
    if len(begins):
        newline = (data[ends - 1] == 10).astype(np.int64)
    size = ends - begins - newline
    total = lambda flag: np.add.reduceat(flag, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    inner = _UPPER[data]
    inner[1:] &= K.WORD[data[:-1]]
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    s, e = K.word_spans(data, offsets)
    h = K.span_hash(K.running(data), s, e)
    w0 = np.searchsorted(s, begins)
    words = np.diff(np.append(w0, len(s)))
    same = np.zeros(len(h) + 1, np.int64)
    same[2:] = np.cumsum(h[1:] == h[:-1])
    inside = np.minimum(w0 + 1, len(h))
    again = same[np.append(w0[1:], len(h))] - same[inside] if len(begins) else words
    letters = np.concatenate([[0], np.cumsum(e - s)])
    letters = letters[w0 + words] - letters[w0]
    n, m = np.maximum(size, 1), np.maximum(words, 1)
    values = [total(inner) / n, total(_MARK[data]) / m, total(_DIGIT[data]) / n, np.maximum(again, 0) / m, total(data == 124) / n, letters / m, words]
    codes = [np.searchsorted(b, v, "right") + base for b, v, base in zip(BINS, values, _BASE)]
    last = np.maximum(ends - newline - 1, 0)
    codes.append(_BASE[-1] + (_END[data[last]] if len(begins) else np.zeros(0, np.int64)))
    return np.stack(codes, 1).astype(np.int16), size, words, np.searchsorted(row, np.arange(len(offsets)))


def _coded(batches):
    for batch in batches:
        for a, data, offsets in K.blocks(batch.column("text"), lower=False):
            codes, _, _, o = line_features(data, offsets)
            n = len(offsets) - 1
            lists = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, n).cast(pa.int32()), lists], ["quality", "lines"])


class Field:
    """weights: score of content over boilerplate for each feature; move[i, j]: score of state j after i; start: of content first."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, start: float):
        self.weights, self.move, self.start = weights, move, start

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[codes].sum(1)


def _steps(o: np.ndarray):
    """For sequences at offsets o, longest first: at each step the lines of those that are as long."""
    order = np.argsort(-np.diff(o), kind="stable")
    begin, length = o[:-1][order], np.diff(o)[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield begin[: np.searchsorted(-length, -t, "left")] + t


def _decoded(field: Field, e: list[float]) -> list[int]:
    """The best states of one sequence, line by line."""
    (m00, m01), (m10, m11) = field.move.tolist()
    zero, one, back = 0.0, e[0] + field.start, []
    for x in e[1:]:
        a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
        back.append((b >= a, d >= c))
        zero, one = b if b >= a else a, (d if d >= c else c) + x
    states = [int(one >= zero)]
    for steps in reversed(back):
        states.append(int(steps[states[-1]]))
    return states[::-1]


def viterbi(field: Field, codes: np.ndarray, o: np.ndarray) -> np.ndarray:
    """The best state of each line, 1 for content; ties are content. Sequences of more than LONG lines are decoded one by one, as few others are as long."""
    e = field.scores(codes)
    long = np.flatnonzero(np.diff(o) > LONG)
    if len(long):
        out, at = np.zeros(len(e), np.int8), 0
        for k in [*long.tolist(), len(o) - 1]:
            out[o[at] : o[k]] = viterbi(field, codes[o[at] : o[k]], o[at : k + 1] - o[at])
            if k < len(o) - 1:
                out[o[k] : o[k + 1]] = _decoded(field, e[o[k] : o[k + 1]].tolist())
            at = k + 1
        return out
    back = np.zeros((len(e), 2), np.int8)
    best = np.zeros((len(e), 2))
    steps = list(_steps(o))
    for t, at in enumerate(steps):
        if t == 0:
            best[at, 1] = e[at] + field.start
            continue
        for j in (0, 1):
            a, b = best[at - 1, 0] + field.move[0, j], best[at - 1, 1] + field.move[1, j]
            back[at, j] = b >= a
            best[at, j] = np.maximum(a, b) + (e[at] if j else 0)
    state = np.zeros(len(e), np.int8)
    last = o[1:][np.diff(o) > 0] - 1
    state[last] = best[last, 1] >= best[last, 0]
    for at in reversed(steps[1:]):
        state[at - 1] = back[at, state[at]]
    return state


def train(codes: np.ndarray, o: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps; labels: the state of each line."""
    walk = list(_steps(o))
    if not walk:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0)
    x = np.zeros(FEATURES + 5)
    m, v = np.zeros_like(x), np.zeros_like(x)
    first = walk[0]
    inner = np.ones(len(codes), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    pairs = np.bincount(labels[inner - 1] * 2 + labels[inner], minlength=4).reshape(2, 2)
    seen = np.bincount(codes.ravel(), weights=np.repeat(labels, codes.shape[1]), minlength=FEATURES)
    for k in range(1, steps + 1):
        field = Field(x[:FEATURES], x[FEATURES : FEATURES + 4].reshape(2, 2), x[-1])
        e = field.scores(codes)
        phi = np.stack([np.zeros_like(e), e], 1)
        a, b = np.zeros((len(e), 2)), np.zeros((len(e), 2))
        a[first] = phi[first] + np.array([0.0, field.start])
        for at in walk[1:]:
            for j in (0, 1):
                a[at, j] = np.logaddexp(a[at - 1, 0] + field.move[0, j], a[at - 1, 1] + field.move[1, j]) + phi[at, j]
        for at in reversed(walk[1:]):
            for i in (0, 1):
                b[at - 1, i] = np.logaddexp(field.move[i, 0] + phi[at, 0] + b[at, 0], field.move[i, 1] + phi[at, 1] + b[at, 1])
        z = np.logaddexp(*(a + b).T)
        p = np.exp(a[:, 1] + b[:, 1] - z)
        joint = np.stack([np.stack([np.exp(a[inner - 1, i] + field.move[i, j] + phi[inner, j] + b[inner, j] - z[inner]).sum() for j in (0, 1)]) for i in (0, 1)])
        g = np.concatenate([seen - np.bincount(codes.ravel(), weights=np.repeat(p, codes.shape[1]), minlength=FEATURES), (pairs - joint).ravel(), [(labels[first] - p[first]).sum()]])
        g = g / len(codes) - PENALTY * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(x[:FEATURES], x[FEATURES : FEATURES + 4].reshape(2, 2), float(x[-1]))


def line_labels(codes: np.ndarray, o: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weak labels of lines from those of documents."""
    of = np.repeat(good, np.diff(o))
    p = [np.bincount(codes[of == c].ravel(), minlength=FEATURES) + 1.0 for c in (0, 1)]
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    labels = np.where(of == 1, 1, (ratio[codes].sum(1) >= 0).astype(int))
    row = K.row_of(o)
    none = np.bincount(row, weights=1 - labels, minlength=len(good)) == 0
    return np.where(none[row] & (of == 0), 0, labels)


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = TRAIN) -> Field | None:
    labelled = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [labelled.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    some = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("quality", "text").mapInArrow(_coded, "quality int, lines array<binary>").collect()
    some = sorted((r for r in some if r["lines"]), key=lambda r: (r["quality"], [bytes(x) for x in r["lines"]]))
    good = np.array([r["quality"] for r in some], np.int64)
    if not good.any() or good.all():
        return None
    codes = np.frombuffer(b"".join(bytes(x) for r in some for x in r["lines"]), np.int16).reshape(-1, len(BINS) + 1).astype(np.int64)
    o = np.concatenate([[0], np.cumsum([len(r["lines"]) for r in some])])
    cuts = np.unique(np.concatenate([o, *(np.arange(a, b, LONG) for a, b in zip(o[:-1], o[1:]) if b - a > LONG)]))  # long sequences train in stretches
    return train(codes, cuts, line_labels(codes, o, good))


def labelled(docs: DataFrame, field: Field | None, keep: float = KEEP) -> DataFrame:
    """doc_id, n_lines, n_content, content_share and is_retained of every row."""

    def run(batches):
        for batch in batches:
            for a, data, offsets in K.blocks(batch.column("text"), lower=False):
                codes, size, words, o = line_features(data, offsets)
                state = (viterbi(field, codes, o) if field else 1) * (words > 0)
                row, n = K.row_of(o), len(offsets) - 1
                total = np.bincount(row, weights=size, minlength=n)
                share = np.round(np.bincount(row, weights=size * state, minlength=n) / np.maximum(total, 1), 6)
                content = np.bincount(row, weights=state, minlength=n).astype(np.int64)
                columns = [batch.column("doc_id").slice(a, n), pa.array(np.diff(o).astype(np.int64)), pa.array(content), pa.array(share), pa.array((share >= keep) & (content > 0))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_content", "content_share", "is_retained"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_lines long, n_content long, content_share double, is_retained boolean")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    workers_import(spark)
    return labelled(docs, fitted(spark, docs, table(spark, sf_dir, "labels")))
