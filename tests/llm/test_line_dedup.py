import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from timelineql.llm import line_dedup as L
from timelineql.llm.common import Scratch

WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(rows):
    lines = [(i, n, WORD.findall(t.lower())) for i, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}) for n, t in enumerate(text.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= L.MIN_WORDS]
    gone = set()
    for k, (i, n, w) in enumerate(lines):
        for j, m, v in lines[:k]:
            if v == w or min(len(v), len(w)) >= L.FUZZY_WORDS and distance(v, w) <= 1:
                gone.add((i, n))
                break
    return gone


def noisy(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, 2)):
        k = rng.randrange(len(w))
        w[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice("abcdef")], ["z"]])
    return w or ["z"]


def test_matches_brute_force(spark, make):
    rng = random.Random(5)
    base = [[rng.choice("abcdef") for _ in range(rng.randint(1, 14))] for _ in range(40)]
    rows = [(i, "\n".join(" ".join(noisy(rng, rng.choice(base))) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    got = L.removals(spark, make(rows)).collect()
    assert {(r["doc_id"], n) for r in got for n, gone in enumerate(r["flags"]) if gone} == brute(rows)
    assert all(r["n_gone"] == sum(r["flags"]) and r["flags"][-1] for r in got)


def test_within_one():
    for a in ("", "a", "ab", "abc", "aab"):
        for b in ("", "a", "ab", "abc", "axc", "abcd", "ba", "aaab"):
            assert L.within_one(np.array(list(a)), np.array(list(b))) == (distance(a, b) <= 1), (a, b)


def test_odd_rows(spark, odd, none, tmp_path):
    got = {}
    for r in L.cut(odd.select("doc_id", "text"), L.removals(spark, odd))[0].collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    want = {}
    for r in odd.collect():
        want.setdefault(r["doc_id"], []).append(r["text"])
    assert got[8] == [""]  # a later document of the same line
    assert {k: sorted(v, key=str) for k, v in got.items() if k != 8} == {k: sorted(v, key=str) for k, v in want.items() if k != 8}
    assert L.removals(spark, none).count() == 0
    kept = L.stage(spark, odd, "")
    assert L.stage(spark, none, "").count() == 0
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 0 and kept.count() == odd.count() - 1


def test_hot_line_and_counts(spark, make):
    docs = make([(i, f"a shared line of exactly these words here\nown words of document number {i} alone and of no other one {i * 7} {i * 13}") for i in range(300)])
    out = L.stage(spark, docs, "").withColumn("n", F.length("text"))
    assert out.where("n <> n_chars").count() == 0
    assert out.where("text like 'a shared%'").count() == 1 and out.count() == 300
    Scratch(spark).drop()


def test_short_lines_keep_a_document(spark, make):
    """A document whose only long line is a repeat stays for its short lines; one of nothing but repeats and marks goes."""
    head = "this header stands in all of the documents here"
    out = {r["doc_id"]: r["text"] for r in L.stage(spark, make([(1, head), (2, head + "\nalpha\nbeta 7"), (3, head + "\n--\n\n"), (4, "日本\n" + head)]), "").collect()}
    assert out == {1: head, 2: "alpha\nbeta 7", 4: "日本"}


def test_long_texts_take_time_in_proportion(spark, make):
    """500,000 equal lines in one document, and one line that stands in many."""
    line = "a line of some words that comes again and again"
    docs = make([(1, "\n".join([line] * 500_000)), (2, line + "\nanother line of quite other words")])
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in L.stage(spark, docs, "").collect()}
    assert out == {1: line + "\n" * 0, 2: "another line of quite other words"} and time.time() - began < 60


def test_no_window_or_list_of_a_hot_key(spark, make):
    docs = make([(1, "x y z")])
    plan = L.removals(spark, docs)._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan  # the lines of one document are gathered, nothing else
