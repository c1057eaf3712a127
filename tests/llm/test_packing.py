import random
import re

import numpy as np

from timelineql.llm import packing as P


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {r: k for k, r in enumerate(bins) if r >= items[i]}.values():
            bins[b] -= items[i]
            go(i + 1, bins)
            bins[b] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def one_by_one(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= x]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_reduction_keeps_an_optimum_and_best_fit_is_best_fit():
    rng = random.Random(1)
    for _ in range(800):
        capacity = rng.choice([10, 15, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = np.bincount(np.array(items, int), minlength=capacity + 1)
        fixed, rest = P.reduced(counts, capacity)
        left = [s for s in range(capacity + 1) for _ in range(rest[s])]
        assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity)
        got = sorted(capacity - sum(s * k for s, k in p) for p, n in P.best_fit(counts, capacity) for _ in range(n))
        assert got == one_by_one(items, capacity)


def check(rows, sizes, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["slot"])
        at = 0
        for k, r in enumerate(b):
            assert r["slot"] == k and r["place"] == at
            at += r["n_tokens"]
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in rows)
    assert got == sorted((str(i), a, min(capacity, n - a)) for i, n in sizes for a in range(0, n, capacity))
    return bins


def test_packs_every_piece_once(spark, make):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 17, rng.randint(1, 150)]))) for i in range(900)]
    bins = check(P.packed(spark, make(rows), capacity=50).collect(), [(i, len(t.split())) for i, t in rows], 50)
    pieces = [min(50, n - a) for n in (len(t.split()) for _, t in rows) for a in range(0, n, 50)]
    assert -(-sum(pieces) // 50) <= len(bins) <= len(one_by_one(pieces, 50))


def test_odd_rows(spark, odd, none):
    sizes = [(r["doc_id"], len(r["text"].split())) for r in odd.collect() if r["text"] and r["text"].strip()]
    check(P.packed(spark, odd).collect(), sizes, P.CAPACITY)
    assert P.packed(spark, none).count() == 0


def test_stage_carries_the_pieces_of_the_documents(spark, make, odd, none):
    """Each row's pieces make up its text again, with its other columns, also of repeated rows, null ids and clashing names."""
    from pyspark.sql import functions as F

    texts = {1: "  a b\tc\n" * 2000, 2: "x", 3: " lead and trail ", 4: "é ü\u2003ö " * 1500}
    docs = make([(i, t, f"s{i}") for i, t in texts.items()] + [(1, texts[1], "s1")])
    got = {}
    for r in P.stage(spark, docs, "").collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert r["source"] == f"s{r['doc_id']}" and r["n_chars"] == len(r["text"]) and r["n_tokens"] == len([w for w in re.split(r"[ \t\n\x0b\f\r]+", r["text"]) if w]) <= P.CAPACITY
    for i, rows in got.items():
        copies = 1 + (i == 1)
        assert len({(r["bin_id"], r["slot"]) for r in rows}) == len(rows)
        starts = sorted({r["start"] for r in rows})
        assert "".join(next(r["text"] for r in rows if r["start"] == s) for s in starts) == texts[i] and len(rows) == copies * len(starts)
    out = P.stage(spark, odd.withColumns({"slot": F.lit("mine"), "row": F.lit(7), "odd name, ü": F.lit(8)}), "")
    assert out.columns[:5] == ["_bin_id", "_slot", "place", "start", "n_tokens"] and out.columns[5:] == [*odd.columns, *[c for c in ("slot", "row", "odd name, ü") if c not in odd.columns]]
    assert {r["slot"] for r in out.collect()} == {"mine"} and P.stage(spark, none, "").count() == 0
    assert sorted(r["doc_id"] or 0 for r in out.where("start = 0").collect()) == sorted(r["doc_id"] or 0 for r in odd.where("text rlike '[^ \\t\\n]'").collect())
