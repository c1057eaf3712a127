"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports coverage and spans.

1. Hashes of all runs of GRAM words of a template are winnowed with windows of WINDOW: the least of each window is a fingerprint, the rightmost of equal ones.
   Templates of more than LONG words have runs and windows of LONG_GRAM and LONG_WINDOW. The templates' fingerprints make two inverted indexes of
   (template, place), which are fixed and small and go along with the tasks.
2. A document's runs are looked up as they are made; for the short templates they are winnowed alike, so that any shared run of GRAM + WINDOW - 1 words shares
   a fingerprint. Each hit says where its template would start; hits of a template whose starts are within a band of each other form a candidate, if they
   hold at least MIN_HITS of the template's fingerprints.
3. At the peaks of a candidate's hits by start, in turn, the template is aligned inside the band (match 1, mismatch and gap less), and reported if matching
   words are at least COVERAGE of the template's. Of overlapping reports the one with more matching words stays, then the better covered, then the earlier template.
   All this is done on neighbouring hits, so that the work stays in proportion to the text, whatever number of licenses it holds.

One pass over the documents without a shuffle. A row per match: start and end are places in characters, end exclusive.

Defined results: null and empty texts have no matches, and documents without a match have no rows; an empty table gives none. Repeated rows are scanned each;
doc_id may be null. Texts are scanned whole; a license that occurs more than once is reported each time. Other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernel as K
from .common import table, workers_import
from .license_texts import TEMPLATES
from .toxicity import Vocabulary

GRAM, WINDOW = 2, 2
LONG, LONG_GRAM, LONG_WINDOW = 400, 5, 8
MIN_HITS, COVERAGE = 0.3, 0.8
GAP, MISMATCH = 0.6, 0.6


def fingerprints(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of word hashes in rows at offsets o: hashes, and the index of their first word."""
    runs = np.maximum(np.diff(o) - GRAM + 1, 0)
    start = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(start[-1]) + np.repeat(o[:-1] - start[:-1], runs)
    g = K.span_hash(K.sequence_sums(h), at, at + GRAM)
    if not len(g):
        return g, at
    left = np.concatenate([[False], g[:-1] >= g[1:]])  # the least of a window of two, the rightmost of equal ones
    right = np.concatenate([g[:-1] < g[1:], [False]])
    head, tail = start[:-1][runs > 0], start[1:][runs > 0] - 1
    left[head], right[tail] = False, False
    only = head[head == tail]
    chosen = left | right
    chosen[only] = True
    return g[chosen], at[chosen]


def grams(h: np.ndarray, o: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words in rows at offsets o, and the index of their first word."""
    runs = np.maximum(np.diff(o) - size + 1, 0)
    start = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(start[-1]) + np.repeat(o[:-1] - start[:-1], runs)
    return K.span_hash(K.sequence_sums(h), at, at + size), at


def winnowed(g: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in a row, those that are the least of a window, the rightmost of equal ones."""
    if len(g) <= window:
        chosen = np.array([len(g) - 1 - int(np.argmin(g[::-1]))], np.int64) if len(g) else np.zeros(0, np.int64)
    else:
        views = np.lib.stride_tricks.sliding_window_view(g, window)
        chosen = np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], 1))
    return g[chosen], at[chosen]


class Index:
    """The templates' words, and the inverted index of the fingerprints of those that are long or not."""

    def __init__(self, templates: list[tuple[str, str]], long: bool = False):
        self.long = long
        column = pa.array([t for _, t in templates], pa.large_string())
        self.words, marks, places = [], [], []
        for _, data, offsets in K.blocks(column, limit=1 << 40):
            h, _, _, o = K.words(data, offsets)
            self.words = [h[a:b] for a, b in zip(o[:-1], o[1:])]
            for t, w in enumerate(self.words):
                mine = w if (len(w) > LONG) == long else w[:0]
                own = np.array([0, len(mine)])
                g, at = winnowed(*grams(mine, own, LONG_GRAM), LONG_WINDOW) if long else fingerprints(mine, own)
                marks.append(g)
                places += [(t, int(p)) for p in at]
        g = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.vocabulary = Vocabulary(np.unique(g))
        self.begin = np.append(np.searchsorted(g[order], self.vocabulary.hashes), len(g))
        self.entries = np.array(places, np.int64).reshape(-1, 2)[order]
        self.prints = [len(m) for m in marks]
        self.band = [max(2, len(w) // 8) for w in self.words]


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Aligns all of a with a stretch of b, where a[i] may meet b[i + shift - band] to b[i + shift + band]: matching words, and first and last matched of b + 1."""
    n, width = len(a), 2 * band + 1
    j = shift - band + np.arange(width)
    exact = b[max(0, shift) : max(0, shift) + n] if shift >= 0 else b[:0]
    if len(exact) == n and np.array_equal(a, exact):
        return n, shift, shift + n
    score, came, best = np.zeros(width), np.zeros((n, width), np.int8), None
    ramp = GAP * np.arange(width)
    for i in range(n):
        at = i + j
        there = (at >= 0) & (at < len(b))
        same = there & (b[np.clip(at, 0, max(0, len(b) - 1))] == a[i]) if len(b) else there
        diagonal = score + np.where(same, 1.0, -MISMATCH)  # along a diagonal, the place in the band stays
        up = np.append(score[1:], -np.inf) - GAP  # a word of a without partner
        here = np.maximum(diagonal, up)
        along = np.maximum.accumulate(here + ramp) - ramp  # words of b without partner
        came[i] = np.where(along > here + 1e-12, 2, np.where(diagonal >= up, np.where(same, 3, 0), 1))
        score = along
    x, i, matched, first, last = int(np.argmax(score)), n - 1, 0, None, 0
    while i >= 0:
        c = came[i, x]
        if c == 2:
            x -= 1
            continue
        if c == 3:
            matched, first = matched + 1, i + shift - band + x
            last = last or first + 1
        x, i = x + (c == 1), i - 1
    return matched, (first if first is not None else 0), last


def _within(b: np.ndarray, base: int, a: np.ndarray, start: np.ndarray, place: np.ndarray, band: int, least: int) -> list[tuple[int, int, int]]:
    """Matches (matching words, first word, last word + 1) of a in a candidate, whose hits are sorted by start: at the peaks of its hits by diagonal in turn, the
    highest first, until no stretch of a band has enough of them."""
    x = int(start[len(start) // 2])
    if base <= x and x + len(a) <= base + len(b) and np.array_equal(b[x - base : x - base + len(a)], a) and (word := start + place).min() >= x and word.max() < x + len(a):
        return [(len(a), x, x + len(a))]  # a copy word for word, and nothing beside it
    out: list[tuple[int, int]] = []  # spans of matches, which are disjoint, in order
    scores = []
    left, word = np.ones(len(start), bool), start + place
    upto = np.searchsorted(start, start + band, "right")
    count = upto - np.arange(len(start))
    peaks = [(-int(count[i]), int(i)) for i in np.flatnonzero(count >= least)]
    heapq.heapify(peaks)
    while peaks:
        high, low = heapq.heappop(peaks)
        if not left[low]:
            continue
        mine = low + np.flatnonzero(left[low : upto[low]])
        if len(mine) < -high:  # some of its hits have gone since: it waits for its turn
            if len(mine) >= least:
                heapq.heappush(peaks, (-len(mine), low))
            continue
        middle = int(np.median(start[mine]))
        begin, end = max(0, middle - base - band), min(len(b), middle - base + len(a) + band)
        k = bisect_right(out, (middle + len(a) // 2, 1 << 62))  # what is matched isn't aligned again
        if k:
            begin = max(begin, out[k - 1][1] - base)
        if k < len(out):
            end = min(end, out[k][0] - base)
        enough = begin < end and len(np.unique(place[mine])) >= least
        matched, x, y = align(a, b[begin:end], middle - base - begin, band) if enough else (0, 0, 0)
        if matched >= COVERAGE * len(a):
            x, y = base + begin + x, base + begin + y
            insort(out, (x, y))
            scores.append((matched, x, y))
            near = slice(*np.searchsorted(start, [x - len(a), y]))  # where the hits inside can start
            left[near] &= (word[near] < x) | (word[near] >= y)
        left[low : np.searchsorted(start, start[mine[-1]], "right")] = False
    order = np.argsort(word, kind="stable")
    rest = list(zip([base, *(y for _, y in out)], [*(x for x, _ in out), base + len(b)]))
    while rest:  # texts with long insertions, whose hits drift by more than a band, are in what the peaks leave
        begin, end = rest.pop()
        mine = np.sort(order[slice(*np.searchsorted(word, [begin, end], sorter=order))])
        if len(mine) < least or len(np.unique(place[mine])) < least:
            continue
        begin, end = max(begin, int(word[mine].min()) - len(a)), min(end, int(word[mine].max()) + 1 + len(a))
        if end - begin > 4 * len(a):  # a text of more insertions than words isn't one: each shorter one is whole in one of these
            rest += [(x, min(end, x + 4 * len(a))) for x in range(begin, end - 2 * len(a), 2 * len(a))]
            continue
        low, high = int(start[mine[0]]), int(start[mine[-1]])
        middle, wide = (low + high) // 2, band + (high - low + 1) // 2
        first = max(begin, middle - wide)
        matched, x, y = align(a, b[first - base : min(end, middle + len(a) + wide) - base], middle - first, wide) if first < end else (0, 0, 0)
        if matched >= COVERAGE * len(a):
            scores.append((matched, first + x, first + y))
            rest += [(begin, first + x), (first + y, end)]
    return scores


def candidates(index: Index, h: np.ndarray, o: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Matches (row, template, matching words, first word, last word + 1) in rows of word hashes, with overlaps."""
    g, at = grams(h, o, LONG_GRAM) if index.long else fingerprints(h, o)
    hit, mark = index.vocabulary.find(g)
    if not len(hit):
        return []
    n = index.begin[mark + 1] - index.begin[mark]
    entry = index.entries[np.repeat(index.begin[mark] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    word = np.repeat(at[hit], n)
    row = np.searchsorted(o, word, "right") - 1
    start = word - entry[:, 1]
    order = np.lexsort((start, entry[:, 0], row))
    row, template, start, place = row[order], entry[order, 0], start[order], entry[order, 1]
    band = np.array(index.band)[template]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (start[1:] - start[:-1] > band[1:])])
    group = np.cumsum(new) - 1
    distinct = np.unique(group * (1 << 20) + place) >> 20
    enough = np.bincount(distinct, minlength=group[-1] + 1) >= np.maximum(1, np.ceil(MIN_HITS * np.array(index.prints)[template[new]]))
    first = np.append(np.flatnonzero(new), len(row))
    found = []
    for k in np.flatnonzero(enough):
        t, r = int(template[first[k]]), int(row[first[k]])
        a, mine = index.words[t], slice(first[k], first[k + 1])
        found += [(r, t, *m) for m in _within(h[o[r] : o[r + 1]], int(o[r]), a, start[mine], place[mine], index.band[t], max(1, int(np.ceil(MIN_HITS * index.prints[t]))))]
    return found


def scan(indexes: list[Index], h: np.ndarray, o: np.ndarray):
    """The matches of all indexes without overlaps, best first in each row."""
    words = indexes[0].words
    found = [m for index in indexes for m in candidates(index, h, o)]
    found.sort(key=lambda m: (m[0], -m[2], -m[2] / len(words[m[1]]), m[1], m[3]))
    kept, here = [], {}
    for m in found:
        spans = here.setdefault(m[0], [])  # disjoint, in order
        k = bisect_right(spans, (m[3], 1 << 62))
        if not (k and spans[k - 1][1] > m[3] or k < len(spans) and spans[k][0] < m[4]):
            spans.insert(k, (m[3], m[4]))
            kept.append(m)
    return kept


def indexes_of(templates: list[tuple[str, str]]) -> list[Index]:
    return [Index(templates), Index(templates, long=True)]


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, template, coverage, n_words, start, end) of every match."""

    def run(batches):
        indexes = indexes_of(templates)
        names = [n for n, _ in templates]
        for batch in batches:
            for a, data, offsets in K.blocks(batch.column("text")):
                h, s, e, o = K.words(data, offsets)
                found = scan(indexes, h, o)
                if not found:
                    continue
                row, t, matched, x, y = (np.array(c, np.int64) for c in zip(*found))
                character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = character[offsets[row]]
                coverage = np.round(matched / np.array([len(w) for w in indexes[0].words])[t], 6)
                columns = [pa.array([names[i] for i in t]), pa.array(t), pa.array(coverage), pa.array(matched), pa.array(character[s[x]] - begin), pa.array(character[e[y - 1]] - begin)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(offsets) - 1).take(pa.array(row)), *columns], ["doc_id", "license", "template", "coverage", "n_words", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, template long, coverage double, n_words long, start long, end long")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return scanned(table(spark, sf_dir, "documents"))
