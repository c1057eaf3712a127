"""Exact top-k search by BM25: an inverted index per shard, block-max WAND with document-ordered cursors, merged with global statistics.

1. One pass over the documents writes the index to the shared folder, once for all queries: shards of at most SHARD_POSTINGS postings or SHARD documents, and for
   each shard and word the list of its documents and counts. Words' document frequencies, the number of documents and their mean length are sums over
   the index: they are global, so scores of shards compare.
2. For each shard the lists of query words come together in a task. Lists are cut at documents divisible by BLOCK, so that the blocks of all lists
   align; each block keeps its greatest score, and each list too.
3. Block-max WAND: each list of a query has a cursor. The cursors are ordered by their documents' block, and the lists' greatest scores are added up in that order
   until they reach the threshold, the k-th best score so far: no document before that list's block, the pivot, can. The cursors before it move there at once. If the
   maxima of the blocks at the pivot then add up to less than the threshold, the block is passed without a look at its postings; else these are
   scored, all documents of the block at a time, and the threshold may rise.
4. Thresholds are seeded: the queries first run over a sample of one shard in SEEDS and the first one, and the k-th best scores found there, which the best of all
   documents can't be below, are where every shard begins. So shards give back few rows, and skip most postings.
5. The top k of all shards are merged by a window. Nothing is approximate.

The score is the sum over query words (a word counts as often as the query has it) of idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), rounded to six places; equal scores rank by doc_id, null last.

Defined results: documents without words (null, empty or only marks) aren't in N and never found; queries without words, or none of whose words occurs, have no
rows, and neither has any query of an empty table. Repeated rows of documents are documents of their own, and repeated rows of queries, by item_id and text,
are one query. Texts of any length are indexed whole. Other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, table

TOP, K1, B = 10, 1.2, 0.75
BLOCK, SHARD, SHARD_POSTINGS = 64, 65_536, 2_000_000
SEEDS = 32
QUERIES_AT_ONCE = 10_000
BROADCAST = 1_000_000
INDEX = "shard long, word long, n long, length long, docs binary, counts binary, ids array<long>"


def _binary(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The stretches of 32-bit values from each place of begin to the next."""
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * 4).astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def _indexed(batches):
    """Rows (shard, word, n, docs, counts) of lists; and of each shard one without a word, that has how many documents have words, their length, each one's and its id."""
    number, schema = TaskContext.get().partitionId() << 32, pa.schema([(n, t) for n, t in [("shard", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64()))]])
    parts, ids, lengths, rows, postings = [], [], [], 0, 0

    def shard():
        word, doc, count = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")  # documents come in order
        word, doc, count = word[order], doc[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        begin, m = np.append(first, len(word)), len(first)
        none = pa.nulls
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(K.signed(word[first])), pa.array(np.diff(begin)), none(m, pa.int64()), _binary(doc, begin), _binary(count, begin), none(m, pa.list_(pa.int64()))], schema=schema)
        length, own = np.concatenate(lengths), pa.concat_arrays(ids)
        whole = pa.array(np.array([0, len(own)], np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([number]), none(1, pa.int64()), pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), _binary(length, np.array([0, len(length)])), none(1, pa.binary()), pa.ListArray.from_arrays(whole, own)], schema=schema)

    for batch in batches:
        for a, data, offsets in K.blocks(batch.column("text")):
            h, _, _, o = K.words(data, offsets)
            r = K.row_of(o)
            _, at, count = np.unique(h ^ K.mix(r.astype(np.uint64)), return_index=True, return_counts=True)
            order = np.argsort(r[at], kind="stable")
            at, count = at[order], count[order]
            parts.append((h[at], r[at] + rows, count))
            ids.append(batch.column("doc_id").slice(a, len(offsets) - 1).cast(pa.int64()))
            lengths.append(np.diff(o))
            rows, postings = rows + len(offsets) - 1, postings + len(at)
            if rows >= SHARD or postings >= SHARD_POSTINGS:
                yield from shard()
                number, parts, ids, lengths, rows, postings = number + 1, [], [], [], 0, 0
    if rows:
        yield from shard()


class Shard:
    """An inverted index of some documents, from postings (word, document, score) of distinct pairs."""

    def __init__(self, word: np.ndarray, doc: np.ndarray, score: np.ndarray, words: int):
        order = np.lexsort((doc, word))
        word, self.doc, self.score = word[order], doc[order], score[order]
        block = self.doc // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(word) else np.zeros(0, np.int64)
        self.begin = np.append(first, len(word))
        self.most = np.maximum.reduceat(self.score, first) if len(first) else np.zeros(0)
        self.lists = np.searchsorted(word[first], np.arange(words + 1))
        self.blocks = int(block.max()) + 1 if len(block) else 1
        self.place = word[first] * self.blocks + block[first]  # ascending over lists and their blocks
        self.block = np.append(block[first], -1)
        full = np.flatnonzero(np.diff(self.lists))
        self.upper = np.zeros(words)
        if len(full):
            self.upper[full] = np.maximum.reduceat(self.most, self.lists[full])

    def top(self, words: np.ndarray, times: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents of the k best rounded scores from least on (and all that tie with the last), those scores, and how many postings were read."""
        some = self.lists[words + 1] > self.lists[words]
        words, times = words[some], times[some].astype(float)
        cursor, end, upper = self.lists[words].copy(), self.lists[words + 1], self.upper[words] * times
        docs, scores, read, done = np.zeros(0, np.int64), np.zeros(0), 0, self.blocks
        at = self.block[cursor]
        while len(at):
            order = np.argsort(at, kind="stable")
            p = int(np.searchsorted(np.cumsum(upper[order]), least - 1e-6)) if least > -np.inf else 0
            if p == len(order) or (pivot := at[order[p]]) == done:
                break
            behind = at < pivot
            if behind.any():
                cursor[behind] = np.searchsorted(self.place, words[behind] * self.blocks + pivot)
                at[behind] = np.where(cursor[behind] < end[behind], self.block[cursor[behind]], done)
            here = np.flatnonzero(at == pivot)
            e, t = cursor[here], times[here]
            if (self.most[e] * t).sum() >= least - 1e-6:
                m = self.begin[e + 1] - self.begin[e]
                posting = np.repeat(self.begin[e] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                read += len(posting)
                total = np.round(np.bincount(self.doc[posting] - pivot * BLOCK, weights=self.score[posting] * np.repeat(t, m)), 6)
                found = np.flatnonzero((total > 0) & (total >= least))
                if len(found):
                    docs, scores = np.concatenate([docs, found + pivot * BLOCK]), np.concatenate([scores, total[found]])
                    if len(scores) >= k:
                        least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                        docs, scores = docs[scores >= least], scores[scores >= least]
            cursor[here] += 1
            at[here] = np.where(cursor[here] < end[here], self.block[cursor[here]], done)
        return docs, scores, read


def _searched(hashes: np.ndarray, idf: np.ndarray, mean: float, queries: list, k: int, seeds: dict):
    """For the rows of one shard: the best documents of each query, in order of score and doc_id, no more than k."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own = np.asarray(t.column("word").is_null())
        head, lists = t.filter(pa.array(own)).combine_chunks(), t.filter(pa.array(~own)).combine_chunks()
        ids = head.column("ids").chunk(0).values if head.num_rows else pa.array([], pa.int64())
        flat = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64)
        length, doc, tf = flat(head.column("docs")), flat(lists.column("docs")), flat(lists.column("counts"))
        word = np.repeat(np.searchsorted(hashes, lists.column("word").to_numpy().view(np.uint64)), lists.column("n").to_numpy())
        shard = Shard(word, doc, idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean)), len(hashes))
        found = [(item, *shard.top(words, times, k, seeds.get(item, -np.inf))) for item, words, times in queries]
        items = np.concatenate([np.zeros(0, np.int64), *(np.full(len(d), item) for item, d, _, _ in found)])
        docs = np.concatenate([np.zeros(0, np.int64), *(d for _, d, _, _ in found)])
        scores = np.concatenate([np.zeros(0), *(s for _, _, s, _ in found)])
        return pa.table({"query": pa.array(items), "doc_id": ids.take(pa.array(docs)), "score": pa.array(scores)})

    return run


def index_of(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The inverted index of all documents, written once."""
    return scratch.save(docs.select("doc_id", "text").mapInArrow(_indexed, INDEX), "index")


def searched(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every query."""
    index = index_of(spark, docs, scratch or Scratch(spark))
    heads = index.where("word is null")
    corpus = heads.agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.min("shard").alias("first")).collect()[0]
    n, mean = corpus["n"] or 0, (corpus["length"] or 0) / max(corpus["n"] or 0, 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out, some = None, []

    def search(rows):
        column = pa.array([r["text"] for r in rows], pa.large_string())
        parts = [(a + np.arange(len(offsets) - 1), *K.words(data, offsets)) for a, data, offsets in K.blocks(column)]
        hashes = np.unique(np.concatenate([p[1] for p in parts]))
        asked = []
        for row, h, _, _, o in parts:
            for i, r in enumerate(row):
                words, times = np.unique(np.searchsorted(hashes, h[o[i] : o[i + 1]]), return_counts=True)
                if len(words):
                    asked.append((int(r), words, times))
        wanted = spark.createDataFrame(pa.table({"word": K.signed(hashes)}))
        lists = index.join(F.broadcast(wanted) if len(hashes) <= BROADCAST else wanted, "word", "left_semi")
        df = np.zeros(len(hashes))
        for r in lists.groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
            df[np.searchsorted(hashes, np.int64(r["word"]).view(np.uint64))] = r["n"]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

        def ranked(rows, seeds):
            of_shards = rows(lists).unionByName(rows(heads)).groupBy("shard")
            found = of_shards.applyInArrow(_searched(hashes, idf, mean, asked, k, seeds), "query long, doc_id long, score double")
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        sample = (F.pmod(F.xxhash64("shard"), F.lit(SEEDS)) == 0) | (F.col("shard") == corpus["first"])
        seeds = {r["query"]: r["score"] for r in ranked(lambda x: x.where(sample), {}).where(F.col("rank") == k).collect()} if n else {}
        items = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "query long, item_id long")
        return ranked(lambda x: x, seeds).join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")

    for r in queries.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        some.append(r)
        if len(some) == QUERIES_AT_ONCE:
            out, some = search(some) if out is None else out.union(search(some)), []
    if some or out is None:
        last = search(some) if some else spark.createDataFrame([], "item_id long, rank int, doc_id long, score double")
        out = last if out is None else out.union(last)
    return out


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of benchmark is a query over all documents."""
    return searched(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"'[^\x00-/:-@\[-`{-\x7f]+'"
SQL = rf"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(lower(text), {_WORDS}) as ws from documents where text is not null
), n as (
  select count(*) as n, avg(len(ws)) as mean from d where len(ws) > 0
), q as (
  select item_id, text, w, count(*) as times from (select item_id, text, unnest(regexp_extract_all(lower(text), {_WORDS})) as w from (select distinct item_id, text from benchmark)) group by all
), t as (
  select r, w, count(*) as tf from (select r, unnest(ws) as w from d) where w in (select w from q) group by all
), f as (
  select w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from t, n group by w, n
), s as (
  select item_id, q.text, d.doc_id, r, round(sum(times * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len(d.ws) / mean))), 6) as score
  from q join f using (w) join t using (w) join d using (r), n group by item_id, q.text, d.doc_id, r
)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from s) where rank <= {TOP}
"""
