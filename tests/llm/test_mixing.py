import math
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from timelineql.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=8), st.integers(0, 10**6))
def test_budgets(counts, budget):
    w, whole = M.budgets(counts, budget)
    if not sum(counts):
        assert not sum(whole)
        return
    assert sum(w) == pytest.approx(1) and sum(whole) == min(budget, int(M.REPEATS * sum(counts)))
    assert all(b <= M.REPEATS * c + 1 for b, c in zip(whole, counts)) and all(not b for b, c in zip(whole, counts) if not c)


def test_exponent_meets_entropy_and_repeats():
    counts = [10_000, 100, 100, 100]
    x = M.exponent(counts, 1000)
    assert M.entropy(M.weights(counts, x)) == pytest.approx(0.95 * math.log(4)) and 0 < x < 1
    y = M.exponent(counts, sum(counts))
    assert y > x and max(sum(counts) * w / c for w, c in zip(M.weights(counts, y), counts)) == pytest.approx(4)
    assert M.exponent([5, 5, 5], 15) == 1


def test_schedule(spark, make):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    docs = make(rows)
    got = M.schedule(spark, docs, block_tokens=200).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    names = sorted(set(source.values()))
    counts = [sum(size[i] for i in size if source[i] == s) for s in names]
    _, shared = M.budgets(counts, sum(counts))
    for s, total, budget in zip(names, counts, shared):
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["position"])
        at = 0
        for r in mine:  # positions are the running tokens: no gap, no overlap, and full epochs before the last
            assert r["position"] == pytest.approx(at / budget) and r["epoch"] == at // total
            at += r["tokens"]
        assert budget <= at < budget + 30
        for e in range(budget // total):
            assert {r["doc_id"] for r in mine if r["epoch"] == e} == {i for i in size if source[i] == s}
    assert len({tuple(r["doc_id"] for r in sorted(got, key=lambda r: r["position"]) if r["source"] == "s0" and r["epoch"] == e) for e in (0, 1)}) == 2


def test_stage_repeats_rows_and_odd_rows(spark, odd, none, make):
    docs = make([(i, "a b c d", "big") for i in range(90)] + [(100 + i, "a b c d", "small") for i in range(10)])
    out = M.stage(spark, docs, "")
    assert out.columns == docs.columns
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["small"] > 10 and n["big"] < 90 and 99 <= sum(n.values()) <= 102
    out = M.stage(spark, odd, "")
    assert out.columns == odd.columns and {1, 2, 3}.isdisjoint({r["doc_id"] for r in out.collect()})
    assert M.schedule(spark, none).count() == 0 and M.stage(spark, none, "").count() == 0


def xx(*values):
    """Spark's xxhash64 of ints (plain), longs (a tuple of one) and strings."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(sizes, source, shared, block_tokens):
    """Every scheduled (doc_id, epoch, position), by going through each source's epochs, permuted blocks and permuted documents one by one."""
    out = {}
    for s, budget in shared.items():
        mine = [i for i in sizes if source[i] == s]
        total = sum(sizes[i] for i in mine)
        blocks, at = max(1, -(-total // block_tokens)), 0
        for epoch in range(-(-budget // total)):
            held = {}
            for i in mine:
                held.setdefault(xx(M.SEED, (i,)) % blocks, []).append(i)
            for block in sorted(held, key=lambda b: (xx(M.SEED + 1, s, epoch, (b,)), b)):
                for i in sorted(held[block], key=lambda i: (xx(M.SEED + 2, epoch, (i,)), i)):
                    if at < budget:
                        out[i, epoch] = at / budget
                    at += sizes[i]
    return out


def test_schedule_against_brute_force(spark, make):
    rng = random.Random(21)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 25))), rng.choice(["a", "a", "a", "b", "ü", ""])) for i in range(-60, 160)]
    sizes = {i: len(t.split()) for i, t, _ in rows if t}
    source = {i: s for i, _, s in rows}
    names = sorted(set(source[i] for i in sizes))
    counts = [sum(n for i, n in sizes.items() if source[i] == s) for s in names]
    _, shared = M.budgets(counts, sum(counts))
    got = {(r["doc_id"], r["epoch"]): r["position"] for r in M.schedule(spark, make(rows), block_tokens=150).collect()}
    want = brute(sizes, source, dict(zip(names, shared)), 150)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_exponents_of_a_fine_search():
    """The exponent is the largest whose weights reach the entropy, or the least above it that keeps every source within its repeats: by trying all of a fine grid."""
    rng = random.Random(22)
    for _ in range(40):
        counts = [rng.randint(1, 10 ** rng.randint(1, 6)) for _ in range(rng.randint(2, 8))]
        grid = [k / 4000 for k in range(4001)]
        flat = max((x for x in grid if M.entropy(M.weights(counts, x)) >= M.TARGET * math.log(len(counts)) - 1e-12), default=0.0)
        held = min((x for x in grid if all(sum(counts) * w <= M.REPEATS * c * (1 + 1e-12) for w, c in zip(M.weights(counts, x), counts))), default=1.0)
        assert M.exponent(counts, sum(counts)) == pytest.approx(max(flat, held), abs=1 / 3999)
