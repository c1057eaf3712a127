"""Near-duplicate documents: MinHash signatures, banding, verification, and connected components by alternating stars.

1. One pass hashes all runs of SHINGLE words of a text and keeps, for each of HASHES multiply-add-shift functions (a universal family), the minimum.
2. Documents of equal signatures collapse to their lowest doc_id, so thousands of exact copies cost one row from here on.
3. Signatures are cut into BANDS; documents that share a band meet in a bucket, and buckets of the same documents are searched once. No bucket is capped, and
   none is ever gathered in one row: its members fall by hash into parts of about PART. Within a part, a search from document to document compares each
   reached signature with all not yet reached, which finds exactly the components of the part's verified pairs, and emits one edge for each document reached.
   Some PIVOTS of a large bucket are members of all its parts, so copies of one document are joined across parts at once. Large buckets whose
   members are then not all in one component are searched once more, by each two of their parts, which leaves out no pair.
4. Edges verified at an estimated Jaccard similarity of THRESHOLD or more go to alternating large-star and small-star rounds, each written
   to the shared folder, until no edge changes: every document then points at the lowest doc_id of its component.

Defined results: a text without words (null, empty or only marks) is in no group. A text of fewer than SHINGLE words is one shingle. doc_id is
a document's identity: rows that repeat it are one document and are decided together; rows of null doc_id are kept, in no group. An empty table has no
groups. Ties don't matter: of a group the lowest doc_id stays. Texts of any length are read whole. Other columns, of whatever names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, fresh, table

SHINGLE = 3
HASHES, BANDS = 128, 32
THRESHOLD = 0.6
PART, PIVOTS = 10_000, 16


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words, and the offsets of each row's; a row of fewer words has one."""
    h, _, _, o = K.words(data, offsets)
    count = np.diff(o)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(runs)])
    first = np.arange(start[-1]) - np.repeat(start[:-1] - o[:-1], runs)
    last = np.minimum(first + size, np.repeat(o[1:], runs))
    return K.span_hash(K.sequence_sums(h), first, last), start


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 64, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, hashes, dtype=np.uint64)


def signatures(data: np.ndarray, offsets: np.ndarray, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their minima as uint32 of shape (rows, hashes)."""
    g, start = shingles(data, offsets)
    full = np.flatnonzero(np.diff(start))
    out = np.empty((len(full), hashes), np.uint32)
    if len(full):
        at, key, t = start[full], g >> np.uint64(32), np.empty_like(g)
        for i, (a, b) in enumerate(zip(*_functions(hashes))):
            np.multiply(key, a, out=t)
            t += b
            out[:, i] = np.minimum.reduceat(t, at) >> np.uint64(32)
    return full, out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each row and band; different bands never share keys but by chance."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _signed(batches):
    for batch in batches:
        for a, data, offsets in K.blocks(batch.column("text")):
            full, s = signatures(data, offsets)
            if not len(full):
                continue
            ids = batch.column("doc_id").slice(a, len(offsets) - 1).take(pa.array(full))
            keys = band_keys(s)
            whole = keys[:, 0].copy()
            for k in range(1, keys.shape[1]):
                whole = K.mix(whole ^ keys[:, k])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * keys.shape[1]), pa.array(K.signed(keys.ravel())))
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * s.shape[1]), len(full), [None, pa.py_buffer(s.tobytes())]).cast(pa.binary())
            batch_out = pa.RecordBatch.from_arrays([ids, pa.array(K.signed(whole)), sig, bands], ["doc_id", "whole", "sig", "bands"])
            yield batch_out.filter(ids.is_valid())


def reached(s: np.ndarray, least: int) -> list[tuple[int, int]]:
    """For signatures as rows: edges (i, j) that span the components of all pairs that agree in least places or more."""
    edges, left = [], np.arange(len(s))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (s[left] == s[i]).sum(1) >= least
            found = left[near]
            edges += [(i, j) for j in found]
            queue += list(found)
            left = left[~near]
    return edges


def _verified(threshold: float, hashes: int):
    least = int(np.ceil(threshold * hashes - 1e-9))

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            o = members.offsets.to_numpy() - members.offsets[0].as_py()
            flat = members.flatten()
            ids = flat.field("doc_id").to_numpy()
            s = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            two = np.flatnonzero(np.diff(o) == 2)
            i = o[two]
            ok = (s[i] == s[i + 1]).sum(1) >= least
            a, b = [ids[i[ok]]], [ids[i[ok] + 1]]
            for k in np.flatnonzero(np.diff(o) > 2):
                part = ids[o[k] : o[k + 1]]
                for x, y in reached(s[o[k] : o[k + 1]], least):
                    a.append(part[x : x + 1])
                    b.append(part[y : y + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(doc_id, root) for all ends of edges (a, b): alternating large-star and small-star, as min over each vertex' neighbours."""

    def state(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("x")).collect()[0]

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        out = both.join(low, "a")
        out = out.where("b > a") if large else out
        moved = out.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            moved = moved.union(low.select("a", F.col("low").alias("b")))
        return moved.where("a <> b").distinct()

    scratch = Scratch(spark)
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    before, k = state(now), 0
    while before["n"]:
        k += 1
        large = scratch.save(star(now, True), f"large{k}")
        then = scratch.save(star(large, False), f"edges{k}")
        after = state(then)
        scratch.drop(f"edges{k - 1}", f"large{k}")
        now = then
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("doc_id"), F.col("b").alias("root"))


def buckets_of(banded: DataFrame) -> DataFrame:
    """From (band, doc_id): (band, doc_id, n) of the members of each bucket of n > 1 documents, of those with the same documents only one."""
    sets = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    return banded.join(sets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "band")


def _part(part: int):
    parts = F.ceil(F.col("n") / part).cast("int")
    return parts, F.pmod(F.xxhash64(F.lit(3), "doc_id"), parts).cast("int")


def in_parts(members: DataFrame, part: int = PART) -> DataFrame:
    """(band, part, doc_id) of members, of which the pivots of a bucket of several parts are in each of them."""
    parts, own = _part(part)
    pivot = (parts > 1) & (F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.col("n")) < PIVOTS)
    return members.select("band", F.explode(F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))).alias("part"), "doc_id")


def in_pairs_of_parts(members: DataFrame, part: int = PART) -> DataFrame:
    """(band, part, doc_id) where each two parts of a bucket are one, numbered by both."""
    parts, own = _part(part)
    other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    each = members.select("band", "doc_id", parts.alias("parts"), own.alias("own"), other).where("own <> other")
    return each.select("band", (F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")).alias("part"), "doc_id")


def groups(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None, part: int = PART) -> DataFrame:
    """(doc_id, root) of every document in a group of near copies but the one that stays, root."""
    scratch = scratch or Scratch(spark)
    signed = scratch.save(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, whole long, sig binary, bands array<long>"), "signatures")
    low = scratch.save(signed.groupBy("whole").agg(F.min("doc_id").alias("root")), "distinct")
    same = signed.select("doc_id", "whole").join(low, "whole").where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    first = signed.join(low.select(F.col("root").alias("doc_id"), "whole"), ["doc_id", "whole"])
    members = scratch.save(buckets_of(first.select("doc_id", F.explode("bands").alias("band")).distinct()), "buckets")

    def searched(parts: DataFrame) -> DataFrame:
        found = parts.join(signed.select("doc_id", "whole", "sig"), "doc_id").groupBy("band", "part").agg(F.sort_array(F.collect_set(F.struct("doc_id", "sig"))).alias("members"))
        return found.select("members").mapInArrow(_verified(threshold, HASHES), "a long, b long")

    edges = scratch.save(searched(in_parts(members, part)).union(same).distinct(), "verified")
    found = components(spark, edges)
    large = members.where(F.col("n") > part)
    if not large.isEmpty():
        root = found.withColumnRenamed("root", "of")
        split = large.join(root, "doc_id", "left").groupBy("band").agg(F.min(F.coalesce("of", "doc_id")).alias("low"), F.max(F.coalesce("of", "doc_id")).alias("high")).where("low <> high").select("band")
        more = searched(in_pairs_of_parts(large.join(split, "band", "left_semi"), part))
        found = components(spark, scratch.save(more.union(edges).distinct(), "all"))
    scratch.drop("signatures", "distinct", "buckets", "verified", "all")
    return found


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group (the lowest doc_id of its near copies, or its own) and whether it stays."""
    docs = table(spark, sf_dir, "documents")
    found = groups(spark, docs)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.col("root").isNull().alias("stays"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the near copies; of each group the lowest doc_id stays."""
    copy, = fresh(docs.columns, "_llm_copy")
    found = groups(spark, docs).select(F.col("doc_id").alias(copy))
    return docs.join(found, docs["doc_id"] == F.col(copy), "left_anti")
