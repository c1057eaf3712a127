"""Repeated lines over the whole corpus: a deletion-neighbourhood join on words, with the earliest line kept.

A line is what stands between newlines. Its words are compared, so case and marks don't count. Lines of fewer than MIN_WORDS words are never removed. Of the
others a line is removed if an earlier one, by (doc_id, line number), has the same words, or, where both have FUZZY_WORDS or more, differs by
one inserted, deleted or replaced word.

1. One pass hashes every line, and marks those that repeat a line of their own text. For each of FUZZY_WORDS or more it hashes the first and last halves
   of its words: two lines of at most L words one edit apart share the first or the last (L - 1) // 2 of them, as the edit cannot lie in both. Contents
   alone in all their halves have no partner. This only spares work: it turns no pair away.
2. For the contents that are left, all deletion variants (the line less each one word) are emitted as hashed keys, from the document that has the content
   first. Lines of an equal variant meet; those that lack the same word position are one replacement apart, and a line that equals another's variant is one
   insertion apart. So the earliest of each is partner enough, and hot variants cost no more than others.
3. Each pair's edit distance is verified on the words themselves.
4. The lines to remove are gathered by document, and the texts are cut without leaving the JVM, in time in proportion to their lines.

Copies of a line, lines of a half, and lines of a variant are never gathered in a row, a window or a list: they are counted by partial aggregation and joined
back, and a join on a hot key is one that adaptive execution can split.

Defined results: null and empty texts stay as they are, and an empty table stays empty. Documents of null doc_id are neither changed nor compared. doc_id is a
document's identity: rows that repeat it are cut alike, and aren't repeats of each other. Of lines that tie, being equal, the one of the lowest doc_id stays, and in
a document the first. Lines and texts of any length are compared whole. Other columns, of whatever names, are kept as they are, but for n_chars, which
the pipeline's stage sets anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .bloom import bloom_of
from .common import Scratch, fresh, table

MIN_WORDS, FUZZY_WORDS = 3, 8
HALVES = ["half0", "half1", "half2", "half3"]


def lines(data: np.ndarray, offsets: np.ndarray):
    """Of each line: its row, its number there, and the index of its first word (with the end); and the words' hashes."""
    h, s, _, _ = K.words(data, offsets)
    cuts = np.flatnonzero(data == 10) + 1
    begins = np.union1d(cuts, offsets[:-1])
    begins = begins[begins < len(data)] if len(data) else begins[:0]
    row = np.searchsorted(offsets, begins, "right") - 1
    first = np.searchsorted(row, row)
    at = np.append(np.searchsorted(s, begins), len(s))
    return row, np.arange(len(row)) - first, at, h


def _halves(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Keys of the first and last halves of the words a to b, as the longer of a pair and as the shorter."""
    out = []
    for longest in (b - a, b - a + 1):
        half = (longest - 1) // 2
        tag = longest.astype(np.uint64) << np.uint64(1)
        out.append(K.mix(K.span_hash(sums, a, a + half) ^ K.mix(tag)))
        out.append(K.mix(K.span_hash(sums, b - half, b) ^ K.mix(tag + np.uint64(1))))
    return out


def _firsts(row: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of lines in rows, whether each is the first of its content in its row."""
    out = np.zeros(len(whole), bool)
    out[np.unique(whole ^ K.mix(row.astype(np.uint64)), return_index=True)[1]] = True
    return out


def _hashed(batches):
    for batch in batches:
        for r0, data, offsets in K.blocks(batch.column("text")):
            row, number, at, h = lines(data, offsets)
            ids = batch.column("doc_id").slice(r0, len(offsets) - 1)
            keep = np.flatnonzero(np.diff(at) >= MIN_WORDS)
            if ids.null_count:
                keep = keep[np.asarray(ids.is_valid())[row[keep]]]
            if not len(keep):
                continue
            a, b = at[keep], at[keep + 1]
            sums = K.sequence_sums(h)
            whole = K.span_hash(sums, a, b)
            first = _firsts(row[keep], whole)
            short = ~first | (b - a < FUZZY_WORDS)
            halves = [pa.array(K.signed(x), mask=short) for x in _halves(sums, a, b)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[keep])), pa.array(number[keep], pa.int32()), pa.array(K.signed(whole)), pa.array(first), *halves], ["doc_id", "line", "whole", "first", *HALVES])


def _document(ids: np.ndarray) -> np.ndarray:
    return K.mix(ids.astype(np.int64).view(np.uint64))


def _of_documents(documents):
    """The rows whose documents may be among those of the filter."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            if batch.num_rows:
                yield batch.filter(pa.array(documents.value.has(_document(batch.column("doc_id").to_numpy()))))

    return run


def _variants(batches):
    """For the lines of the contents that a row is asked for: their words, and (key, position) of each word left out; the line itself has -1."""
    for batch in batches:
        asked = batch.column("contents")
        begins, flat = asked.offsets.to_numpy(), asked.values.to_numpy().view(np.uint64)
        for r0, data, offsets in K.blocks(batch.column("text")):
            row, number, at, h = lines(data, offsets)
            own = batch.column("doc_id").slice(r0, len(offsets) - 1).to_numpy()[row]
            n, sums = np.diff(at), K.sequence_sums(h)
            keep = np.flatnonzero(n >= FUZZY_WORDS)
            whole = K.span_hash(sums, at[keep], at[keep + 1])
            mine = slice(begins[r0], begins[r0 + len(offsets) - 1])
            wanted = flat[mine] ^ K.mix(K.row_of(begins[r0 : r0 + len(offsets)] - begins[r0]).astype(np.uint64))
            keep = keep[np.isin(whole ^ K.mix(row[keep].astype(np.uint64)), wanted) & _firsts(row[keep], whole)]
            if not len(keep):
                continue
            a, b, n = at[keep], at[keep + 1], n[keep]
            begin = np.concatenate([[0], np.cumsum(n)])
            line = np.repeat(np.arange(len(keep)), n)
            position = np.arange(begin[-1]) - begin[line]
            x, y, w = a[line], b[line], a[line] + position
            key = _joined(sums, x, w, y)
            self_key = _joined(sums, a, b, None)
            order = np.insert(np.arange(len(key)), begin[:-1], -1)  # each line's own key before its variants'
            keys = np.where(order < 0, 0, key[np.maximum(order, 0)])
            keys[order < 0] = self_key
            positions = np.where(order < 0, -1, position[np.maximum(order, 0)])
            o = pa.array((begin + np.arange(len(begin))).astype(np.int32))
            words = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(K.signed(h[w])))
            variants = pa.ListArray.from_arrays(o, pa.StructArray.from_arrays([pa.array(K.signed(keys)), pa.array(positions, pa.int32())], ["key", "position"]))
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(number[keep], pa.int32()), pa.array(K.signed(K.span_hash(sums, a, b))), words, variants], ["doc_id", "line", "whole", "words", "variants"])


def _joined(sums: np.ndarray, a: np.ndarray, w: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """The hash of words a to b without word w; without b, of a to w."""
    power, inverse = K.powers(len(sums))
    front = (sums[w] - sums[a]) * inverse[a]
    if b is not None:
        front = front + (sums[b] - sums[w + 1]) * inverse[a] * inverse[np.ones(1, int)]
    return K.mix(front)


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one inserted, deleted or replaced element at most makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    differ = np.flatnonzero(a[: len(b)] != b[: len(a)])
    k = int(differ[0]) if len(differ) else min(len(a), len(b))
    return np.array_equal(a[k + (len(a) >= len(b)) :], b[k + (len(b) >= len(a)) :])


def _verified(batches):
    for batch in batches:
        sides = []
        for c in ("words", "other_words"):
            o = batch.column(c).offsets.to_numpy()
            sides.append((o, batch.column(c).values.to_numpy()))
        (p, a), (q, b) = sides
        ok = [within_one(a[p[i] : p[i + 1]], b[q[i] : q[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("whole").filter(pa.array(ok, pa.bool_()))], ["whole"])


def near_repeats(spark: SparkSession, docs: DataFrame, hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(whole) of lines that have an earlier line of other words one edit away."""
    each = hashed.where("half0 is not null").select("whole", F.explode(F.array(*HALVES)).alias("half"))
    shared = each.groupBy("half").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high").select("half")
    paired = each.join(shared, "half", "left_semi").select("whole").distinct()
    first = hashed.where("half0 is not null").join(paired, "whole", "left_semi").groupBy("whole").agg(F.min("doc_id").alias("doc_id"))
    asked = scratch.save(first.groupBy("doc_id").agg(F.collect_list("whole").alias("contents")), "asked")
    some = docs.select("doc_id", "text").mapInArrow(_of_documents(bloom_of(spark, asked.select("doc_id"), lambda b: _document(b.column("doc_id").to_numpy()))), "doc_id long, text string")
    found = some.join(asked.hint("shuffle_hash"), "doc_id").mapInArrow(_variants, "doc_id long, line int, whole long, words array<long>, variants array<struct<key:long,position:int>>")
    found = scratch.save(found, "variants")

    rows = found.select(F.struct("doc_id", "line", "whole").alias("at"), F.inline("variants"))
    own, apart = F.col("position") < 0, F.col("position") >= 0
    keys = rows.groupBy("key").agg(
        F.min(F.when(own, F.col("at"))).alias("shorter"), F.min(F.when(apart, F.col("at"))).alias("longer"), F.min("at.whole").alias("low"), F.max("at.whole").alias("high")
    ).where("low <> high").drop("low", "high")
    met = scratch.save(rows.join(keys, "key"), "met")
    beside = met.where(apart).groupBy("key", "position").agg(F.min("at").alias("beside"))
    met = met.join(beside, ["key", "position"], "left")
    other = F.when(own, F.col("longer")).otherwise(F.least("shorter", "beside"))
    pairs = met.select(F.col("at.whole").alias("whole"), "at", other.alias("other")).where("other < at and other.whole <> whole").select("whole", F.col("other.whole").alias("other")).distinct()
    text = found.groupBy("whole").agg(F.first("words").alias("words"))
    texts = pairs.join(text, "whole").join(text.select(F.col("whole").alias("other"), F.col("words").alias("other_words")), "other")
    return texts.select("whole", "words", "other_words").mapInArrow(_verified, "whole long").distinct()


def _flagged(batches):
    """For the numbers of lines, whether each line up to the last of them is among them."""
    for batch in batches:
        gone = batch.column("gone")
        o, flat = gone.offsets.to_numpy(), gone.values.to_numpy()
        n = np.array([flat[a:b].max() + 1 for a, b in zip(o[:-1], o[1:])], np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        flags = np.zeros(begin[-1], bool)
        flags[flat[o[0] : o[-1]] + np.repeat(begin[:-1], np.diff(o))] = True
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(o).astype(np.int32)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flags))], ["doc_id", "n_gone", "flags"])


def removals(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_gone, flags) of documents that lose lines: how many, and for each line up to the last of those whether it goes."""
    scratch = scratch or Scratch(spark)
    halves = ", ".join(f"{h} long" for h in HALVES)
    hashed = scratch.save(docs.select("doc_id", "text").mapInArrow(_hashed, f"doc_id long, line int, whole long, first boolean, {halves}"), "lines")
    near = scratch.save(near_repeats(spark, docs, hashed, scratch), "near")
    scratch.drop("asked", "variants", "met")
    again = hashed.where("first").groupBy("whole").agg(F.min("doc_id").alias("since"), F.max("doc_id").alias("last")).where("since < last")
    known = again.select("whole", "since", F.lit(False).alias("near")).union(near.select("whole", F.lit(None).cast("long"), F.lit(True))).groupBy("whole").agg(F.min("since").alias("since"), F.max("near").alias("near"))
    gone = hashed.where("first").join(known, "whole").where("near or doc_id > since").select("doc_id", "line").union(hashed.where("not first").select("doc_id", "line"))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("gone")).mapInArrow(_flagged, "doc_id long, n_gone int, flags array<boolean>")


def cut(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, str]:
    """All columns of docs, with the text cut, and how many lines it lost in a last column (null for none); and that column's name."""
    own, n, flags = fresh(docs.columns, "_llm_id", "_llm_gone", "_llm_flags")
    both = docs.join(gone.toDF(own, n, flags).hint("shuffle_hash"), docs["doc_id"] == F.col(own), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get(F.col(flags), i), F.lit(False))), "\n")
    return both.withColumn("text", F.when(F.col(n).isNull(), F.col("text")).otherwise(left)).drop(own, flags), n


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less the repeated lines, and how many those were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, n = cut(docs, removals(spark, docs))
    return out.select("doc_id", F.coalesce(n, F.lit(0)).alias("n_removed"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with texts cut and n_chars set anew; a document that lost lines and has no word left goes, being nothing but repeats."""
    out, n = cut(docs, removals(spark, docs))
    out = out.where(F.col(n).isNull() | F.col("text").rlike(_WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


_WORD = r"[^\x00-/:-@\[-`{-\x7f]"
_WORDS = r"'[^\x00-/:-@\[-`{-\x7f]+'"
SQL = rf"""
with l as (
  select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as t from (select distinct doc_id, text from documents where doc_id is not null and text is not null)
), w as (
  select doc_id, line, regexp_extract_all(lower(t), {_WORDS}) as ws from l
), e as (
  select doc_id, line, ws, len(ws) as n, doc_id * 1000000 + line as ord from w where len(ws) >= {MIN_WORDS}
), d as (
  select ws, n, min(ord) as ord from e group by all
), v as (
  select ord, n, ws, i as p, list_slice(ws, 1, i - 1) || list_slice(ws, i + 1, n) as v from (select *, unnest(range(1, n + 1)) as i from d where n >= {FUZZY_WORDS})
), near as (
  select distinct a.ws from v a join v b on a.v = b.v and a.p = b.p and b.ord < a.ord
  union select a.ws from v a join d b on a.v = b.ws and b.n >= {FUZZY_WORDS} and b.ord < a.ord
  union select a.ws from d a join v b on b.v = a.ws and a.n >= {FUZZY_WORDS} and b.ord < a.ord
), gone as (
  select e.doc_id, e.line from e join d using (ws) where e.ord > d.ord or e.ws in (select ws from near)
), k as (
  select l.doc_id, count(g.line) as n_removed, coalesce(string_agg(l.t, chr(10) order by l.line) filter (g.line is null), '') as text
  from l left join gone g on l.doc_id = g.doc_id and l.line = g.line group by l.doc_id
)
select documents.doc_id, coalesce(k.n_removed, 0)::int as n_removed, coalesce(k.text, documents.text) as text from documents left join k on documents.doc_id = k.doc_id
"""
