import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from timelineql.llm import kernel as K
from timelineql.llm import near_dedup as N


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def test_recall_and_precision_against_brute_force(spark, make):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 5)):
            rate = rng.choice([0, 0.01, 0.03])
            texts.append(" ".join(f"n{rng.randrange(5000)}" if rng.random() < rate else w for w in base))
    docs = make(list(enumerate(texts)))
    group = {r["doc_id"]: r["root"] for r in N.groups(spark, docs).collect()}
    assert group == {r["doc_id"]: r["root"] for r in N.groups(spark, docs, part=2).collect()}
    same = lambda i, j: group.get(i, i) == group.get(j, j)
    pairs = [(i, j, jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j, s in pairs if s >= 0.7]
    assert sum(same(i, j) for i, j in near) >= 0.97 * len(near)
    assert not any(same(i, j) for i, j, s in pairs if s < 0.2)


def test_signatures_estimate_jaccard():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(60, 400))
    (_, data, offsets), = K.blocks(pa.array([a, b, "", "!"]))
    full, s = N.signatures(data, offsets)
    assert full.tolist() == [0, 1] and abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.1


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 540)] + [(700, 701), (701, 702), (702, 700)] + [(9, 9)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["root"] for r in N.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_reached_spans_components_without_a_cap():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 9, (6, 32), dtype=np.uint32)
    s = np.repeat(base, 50, 0)
    s[rng.random(s.shape) < 0.1] = 99
    edges = N.reached(s, 22)
    assert len(edges) == 6 * 49 and all(i // 50 == j // 50 for i, j in edges)


def test_odd_rows(spark, odd, none):
    kept = N.stage(spark, odd, "")
    assert kept.columns == odd.columns
    want = sorted(str(r["doc_id"]) for r in odd.collect() if r["doc_id"] != 8)  # 8 copies 7, whose rows are one document
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert N.groups(spark, none).count() == 0


def test_thousands_of_copies(spark, make):
    text = " ".join(f"t{i}" for i in range(80))
    docs = make([(i, text) for i in range(3000)] + [(5000 + i, f"{text} x{i} y{i}") for i in range(200)] + [(9000, re.sub("t", "u", text))])
    assert sorted(r["doc_id"] for r in N.stage(spark, docs, "").collect()) == [0, 9000]


def test_parts_hold_every_pair(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(10)] + [(2, i, 2) for i in (7, 8)], "band long, doc_id long, n long")
    every = {(1, a, b) for a in range(10) for b in range(a + 1, 10)} | {(2, 7, 8)}

    def together(rows):
        held = {}
        for r in rows:
            held.setdefault((r["band"], r["part"]), []).append(r["doc_id"])
        assert all(len(v) == len(set(v)) for v in held.values())
        return {(k[0], a, b) for k, v in held.items() for a in v for b in v if a < b}

    for part in (1, 2, 3, 10, 50):
        own, pairs = N.in_parts(df, part).collect(), N.in_pairs_of_parts(df, part).collect()
        assert {r["doc_id"] for r in own if r["band"] == 1} == set(range(10))
        assert together(own) | together(pairs) == every


def test_equal_buckets_are_searched_once(spark):
    rows = [(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (3, 6), (3, 7), (4, 8)]
    got = sorted(tuple(r) for r in N.buckets_of(spark.createDataFrame(rows, "band long, doc_id long")).collect())
    assert got == [(1, 5, 2), (1, 6, 2), (3, 5, 3), (3, 6, 3), (3, 7, 3)]


def test_a_bucket_of_two_million_documents_is_in_no_row_or_task(spark):
    """Ids only: members of a huge bucket stay one to a row, and no part holds much more than PART."""
    n = 2_000_000
    members = N.buckets_of(spark.range(n).select(F.lit(1).cast("long").alias("band"), F.col("id").alias("doc_id")))
    sizes = N.in_parts(members).groupBy("band", "part").count().agg(F.count("*").alias("parts"), F.max("count").alias("most"), F.sum("count").alias("all")).collect()[0]
    assert sizes["parts"] == n // N.PART and sizes["most"] < 1.1 * N.PART and n <= sizes["all"] < 1.05 * n
    assert "array" not in members.schema.simpleString() + N.in_pairs_of_parts(members).schema.simpleString()
