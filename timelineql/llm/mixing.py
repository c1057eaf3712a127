"""Mixing sources to target weights: temperature, bisection, and budgeted block permutations.

1. Tokens (runs of non-space characters) are summed by source; shares p are raised to an exponent in 0..1 and normalised to weights. Bisection finds
   the largest exponent whose weights' entropy reaches TARGET of the greatest possible, then raises it as far as needed for no source to be
   repeated more than REPEATS times; that limit wins. The budget, by default all tokens of the corpus, is shared out in whole tokens.
2. A source's documents fall by hash into blocks of about BLOCK_TOKENS. In each epoch the blocks are permuted, and the documents in each block.
   A document's position is the tokens before it: of earlier epochs, of earlier blocks, and within its block. It is scheduled in an epoch if that
   is under the source's budget. Only blocks are ever sorted by source, so a hot source is spread over as many tasks as it has blocks.
3. ``position`` is the place in 0..1 of the source's budget: reading all sources in its order mixes them at the target weights throughout.

Defined results: null is a source of its own, like the empty name. doc_id is a document's identity: rows that repeat it are one document, scheduled
together, of the least source; null is an id too. Documents without
tokens (null, empty and blank texts) aren't scheduled; a source that has no others has no weight. An empty table has an empty schedule. Texts of any length
are counted whole, and a document longer than a block is a block's whole content or more. Remainders of the budget that tie go to the source that sorts
first, and blocks and documents whose hashes tie are ordered by themselves. Other columns, of whatever names, are kept by the pipeline's stage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

TARGET, REPEATS = 0.95, 4.0
BLOCK_TOKENS = 1 << 21
SEED = 11


def tokens(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def weights(counts: list[int], exponent: float) -> list[float]:
    powers = [(c / max(1, sum(counts))) ** exponent if c else 0.0 for c in counts]
    return [p / (sum(powers) or 1) for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def _bisect(holds, steps: int = 60) -> float:
    """The least x of 0..1 from which holds is true, given that it turns true once."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent(counts: list[int], budget: int, target: float = TARGET, repeats: float = REPEATS) -> float:
    n = sum(c > 0 for c in counts)
    enough = target * math.log(max(n, 1)) - 1e-12
    flat = 1 - _bisect(lambda x: entropy(weights(counts, 1 - x)) >= enough)
    held = _bisect(lambda x: all(budget * w <= repeats * c * (1 + 1e-12) for w, c in zip(weights(counts, x), counts)))
    return max(flat, held)


def budgets(counts: list[int], budget: int, target: float = TARGET, repeats: float = REPEATS) -> tuple[list[float], list[int]]:
    """Weights, and whole tokens by largest remainder; beyond what the repeats allow of all sources, the budget isn't spent."""
    budget = min(budget, int(repeats * sum(counts)))
    w = weights(counts, exponent(counts, budget, target, repeats))
    whole = [math.floor(budget * x) for x in w]
    rest = sorted(range(len(w)), key=lambda i: (whole[i] - budget * w[i], i))
    for i in rest[: max(0, budget - sum(whole)) if sum(counts) else 0]:
        whole[i] += 1
    return w, whole


def schedule(spark: SparkSession, docs: DataFrame, budget: int | None = None, target: float = TARGET, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, epoch, tokens, position) of every scheduled document and epoch."""
    scratch = scratch or Scratch(spark)
    sized = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens().alias("tokens")).groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")).where("tokens > 0")
    sized = scratch.save(sized, "sized")
    sources = sorted((r["source"], r["tokens"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect())
    counts = [t for _, t in sources]
    _, shared = budgets(counts, sum(counts) if budget is None else budget, target, repeats)
    rows = [(s, t, b, max(1, -(-t // block_tokens)), -(-b // t) if t else 0) for (s, t), b in zip(sources, shared)]
    plan = spark.createDataFrame(rows, "source string, total long, budget long, blocks long, epochs long").where("epochs > 0")
    placed = (
        sized.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, "source")
        .withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), "blocks")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)))
    )
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["source", "epoch", "block"]
    starts = placed.groupBy(*key).agg(F.sum("tokens").alias("tokens"))
    starts = starts.withColumn("start", before(Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(SEED + 1), *key), "block"))).drop("tokens")
    inside = placed.withColumn("inside", before(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(SEED + 2), "epoch", "doc_id"), "doc_id")))
    at = F.col("epoch") * F.col("total") + F.col("start") + F.col("inside")
    return inside.join(starts, key).withColumn("at", at).where("at < budget").select("doc_id", "source", "epoch", "tokens", (F.col("at") / F.col("budget")).alias("position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, each as often as it is scheduled."""
    own, times = fresh(docs.columns, "_llm_id", "_llm_times")
    often = schedule(spark, docs).groupBy("doc_id").agg(F.count("*").cast("int")).toDF(own, times).hint("shuffle_hash")
    out = docs.join(often, docs["doc_id"].eqNullSafe(F.col(own))).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*docs.columns)
