"""The pipeline's stages chained, against what each does by itself; and the guard of the entry point."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as C


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, make):
    import random

    rng = random.Random(8)
    home = tmp_path_factory.mktemp("data")
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(n))
    shared = text(60)
    bad = ["vile", "scum", "idiot", "moron"]
    rows, labels = [], []
    for i in range(240):
        t = text(rng.randint(30, 90))
        if i % 8 == 0:
            t += " " + " ".join(rng.sample(bad, 3))
        if i % 10 == 1:
            t += "\n" + shared
        rows.append((i, t + "\n" + text(30), f"s{i % 3}"))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(1000 + i, rows[i + 1][1].replace("w1 ", "x1 ", 1), "s0") for i in range(0, 40, 2)]
    make(rows).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home), dict((r[0], r[1]) for r in rows), shared


def test_stages(spark, tables):
    home, texts, shared = tables
    docs = spark.read.parquet(f"{home}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, home).cache()
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    copied = {1000 + i: i + 1 for i in range(0, 40, 2)}
    assert set(kept["toxicity"]) == {i for i in texts if copied.get(i, i) % 8}
    assert sum(shared in t for t in kept["line dedup"].values()) == 1
    assert not {i for i in kept["near dedup"] if i in copied and copied[i] in kept["near dedup"] and len(kept["line dedup"][i]) > 300}
    assert {i for i in texts if i < 240 and i % 8} <= set(kept["near dedup"])  # no clean document goes
    packed = C.STAGES[-1][1](spark, docs, home)
    n = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    times = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert n == {i: times[i] * len(t.split()) for i, t in kept["mixing"].items()}
    assert packed.groupBy("bin_id").agg({"n_tokens": "sum"}).where("`sum(n_tokens)` > 2048").count() == 0
    whole = C.run(spark, home)
    assert whole.columns == packed.columns and whole.count() == packed.count()


def test_whole_run_against_brute_force(spark, make, tmp_path):
    """Toxicity, repeated lines, near copies and the mixing schedule by their brute-force versions, one after the other; and what the packed rows hold."""
    import random

    from test_line_dedup import brute as repeated_lines
    from test_mixing import brute as mixed
    from test_near_dedup import jaccard
    from test_toxicity import brute as lexicon_of

    from timelineql.llm import line_dedup, mixing, packing

    rng = random.Random(77)
    bad = ["vile", "scum", "idiot", "moron", "oaf"]
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.45)) % 6000}" for _ in range(n))
    shared = text(15)
    texts, labels, source = {}, {}, {}
    for i in range(260):
        t = text(rng.randint(60, 120))
        if i % 7 == 0:
            t += " " + " ".join(rng.sample(bad, 3))
        if i % 9 == 1:
            t += "\n" + shared
        texts[i], source[i] = t, "abc"[min(2, i % 5)]
        if i < 200:
            labels[i] = int(i % 7 == 0)
    for i in range(0, 60, 3):  # near copies: two words of one line are others, so that the lines aren't repeats but the documents are alike
        if "\n" in texts[i + 1]:
            continue
        w = texts[i + 1].split(" ")
        w[5], w[50] = f"new{i}", f"other{i}"
        texts[1000 + i], source[1000 + i] = " ".join(w), "a"
    make([(i, t, source[i]) for i, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    weights, threshold = lexicon_of({i: t.replace("\n", " ") for i, t in texts.items()}, labels)
    kept = {i: t for i, t in texts.items() if round(sum(v for w, v in weights.items() if w in t.split()), 6) < threshold}
    assert set(texts) - set(kept) >= {i for i in range(260) if i % 7 == 0}
    gone = repeated_lines(list(kept.items()))
    cut = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in kept.items()}
    kept = {i: t for i, t in cut.items() if t.split() or t == texts[i]}
    alone = set()
    for i in sorted(kept):
        s = {j: jaccard(kept[i], kept[j]) for j in alone}
        assert all(x >= 0.75 or x < 0.35 for x in s.values())  # no pair that the estimate could put on either side
        if not any(x >= 0.75 for x in s.values()):
            alone.add(i)
    sizes = {i: len(kept[i].split()) for i in alone}
    names = sorted({source[i] for i in alone})
    counts = [sum(n for i, n in sizes.items() if source[i] == s) for s in names]
    times = {}
    for i, _ in mixed(sizes, source, dict(zip(names, mixing.budgets(counts, sum(counts))[1])), mixing.BLOCK_TOKENS):
        times[i] = times.get(i, 0) + 1

    out = C.run(spark, str(tmp_path)).collect()
    got, full = {}, {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        full[r["bin_id"]] = full.get(r["bin_id"], 0) + r["n_tokens"]
        assert r["text"] == kept[r["doc_id"]] and r["source"] == source[r["doc_id"]] and r["n_tokens"] == sizes[r["doc_id"]]
    assert got == times and max(full.values()) <= packing.CAPACITY and line_dedup.MIN_WORDS == 3


def test_odd_rows_go_through_all_stages(spark, odd, none, tmp_path):
    """Nulls, empty texts, long ones, repeated rows, null ids and clashing names; and empty tables."""
    for name, docs in (("odd", odd), ("none", none)):
        home = tmp_path / name
        docs.write.parquet(f"{home}/documents.parquet")
        spark.createDataFrame([(7, None, 1), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
        out = C.run(spark, str(home))
        assert out.columns[-len(docs.columns) :] == docs.columns
        ids = {r["doc_id"] for r in out.collect()}
        assert ids == ({None, 4, 5, 6, 7, 9, 10} if name == "odd" else set())  # texts without words take no place, and 8 is a repeat of 7


def test_entry_lists_the_queries():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in found if q.startswith("op")} and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)


def test_words_of_the_whole_graph_reject_documents(spark, make, tmp_path):
    """The first stage drops documents for a word that no label shows and that stands beside seeds in two fifths of its documents."""
    import random

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(900)}" for _ in range(30)]
        if i % 6 == 0:
            words += rng.sample(["vile", "scum", "idiot", "moron"], 2)
        if i % 30 in (1, 6):
            words += ["zounds", "vile"] if i % 30 == 6 and "vile" not in words else ["zounds"]
        if i % 60 == 31:
            words += ["zounds"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 30 not in (1, 6):
            labels.append((i, 1, int(i % 6 == 0)))
    docs = make(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in C.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    assert not kept & set(range(0, 600, 6)) and not kept & set(range(1, 600, 30))
    assert kept == set(range(600)) - set(range(0, 600, 6)) - set(range(1, 600, 30))
