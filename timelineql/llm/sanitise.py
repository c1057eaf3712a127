"""Information-theoretic sanitisation of personal data: entities are generalised, and so are terms that the corpus shows to reveal them.

1. Recognisers find direct identifiers (RULES): addresses, numbers, keys. Each distinct value is a protected entity.
2. One pass over the corpus gathers the entities and the words of each document with a mention: c(e, t) counts the documents they share, and df(e) those of e.
3. For these words one more pass counts df(t) over all documents. Pairs are made only of words rare enough to reveal an entity of the document at all;
   this turns no revealing pair away.
4. The disclosure of e by t is PMI(e; t) / IC(e): the pointwise mutual information, log p(t | e) / p(t), in units of the entity's own information
   content, log N / df(e), where p(t | e) is shrunk towards p(t) by PRIOR documents, so that entities of one document are measured like all
   others; 1 says that whoever sees t knows that it is e. From DISCLOSURE on, the word is generalised where it is a number, and removed otherwise,
   wherever it stands in documents that mention e.
5. In the last pass mentions become [EMAIL] and the like, and revealing terms go.

What the tasks are sent is a Bloom filter of bounded size, then exact joins; revealing pairs are broadcast as hashes while they are at most BROADCAST,
and joined to their documents beyond that, with the same result.

Defined results: null stays null, empty stays empty. Texts without an entity come out unchanged. Repeated rows count as documents of their own; doc_id may
be null. Texts are read whole, of any length. An empty table has no rows, and other columns, of whatever names, aren't read. Ties: a term whose disclosure is
exactly DISCLOSURE goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .bloom import bloom_of
from .common import Scratch, table

DISCLOSURE, PRIOR = 0.7, 1.0
BROADCAST = 4_000_000
#: In order: of overlapping matches the earliest stays, and of those that begin together the first rule's.
RULES = [
    ("SECRET", r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)\b["']?\s*(?:=|:(?=\s*[^\s]*\d))\s*["']?[^\s"']{6,}["']?)"""),
    ("SECRET", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[opsu]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9_-]{20,}|\b(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}\b"),
    ("EMAIL", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?!\d)|(?<![\d.])\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<![\d.])\d{13,19}(?!\d)"),
    ("PHONE", r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"),
    ("SSN", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("IP", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)|(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"),
]
_FINDER = regex.compile("|".join(f"(?P<k{i}>{pattern})" for i, (_, pattern) in enumerate(RULES)))
_WORD = regex.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
#: The rules' own digits beyond ASCII: Arrow knows those of an older Unicode only.
_NATIVE = "".join(regex.findall(r"\d", "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x110000)]))))
_HEADS = f"AKIA|ASIA|gh[opsu]_|sk-|[0-9a-fA-F]{{32}}|[A-Z]{{2}}[0-9]{{2}}|[{_NATIVE}]"
_DIGIT = np.zeros(256, np.int64)
_DIGIT[ord("0") : ord("9") + 1] = 1
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "@=:"]] = True


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions as (start, end, kind, value), where the value is without case, spaces and marks at its ends."""
    return [(m.start(), m.end(), RULES[int(m.lastgroup[1:])][0], regex.sub(r"[\s()\-]", "", m.group().lower()).strip("\"'.")) for m in _FINDER.finditer(text)]


def _suspects(column: pa.Array):
    """Rows that could hold a mention: no rule matches without an @, four digits, an = or :, a digit of another script, a run of 32 hexadecimal digits, or the head of a known kind of key or of an account number."""
    keys = np.asarray(pc.match_substring_regex(K.strings(column), _HEADS))
    for a, data, offsets in K.blocks(column, lower=False):
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            at = offsets[:-1][full]
            digits = np.add.reduceat(_DIGIT[data], at)
            marks = np.logical_or.reduceat(_SIGN[data], at)
            yield from (a + full[(digits >= 4) | marks | keys[a + full]]).tolist()


def _words(text: str, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words outside all mentions, and their (start, end)."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    free = np.ones(len(spans), bool)
    for s, e, _, _ in found:
        free[np.searchsorted(spans[:, 1], s, "right") : np.searchsorted(spans[:, 0], e, "left")] = False
    (_, data, offsets), = K.blocks(pa.array([text]))
    return K.words(data, offsets)[0][free], spans[free]


def _hash(s: str) -> int:
    data = np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8)
    return int(K.span_hash(K.running(data), np.array([0]), np.array([len(data)]))[0])


def _own(found: list) -> np.ndarray:
    """The distinct entities of these mentions."""
    return np.array(sorted({_hash(f"{kind} {value}") for _, _, kind, value in found}), np.uint64)


def _pair(entity: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix(entity * np.uint64(0x9E3779B97F4A7C15) + word)


def _lists(arrays: list) -> pa.Array:
    at = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(K.signed(np.concatenate([np.zeros(0, np.uint64), *arrays]))))


def _gathered(batches):
    """Of each row with mentions: its entities, and its words outside them, each once."""
    for batch in batches:
        column, row, entity, word = batch.column("text"), [], [], []
        for k in _suspects(column):
            text = column[k].as_py()
            found = entities(text)
            if found:
                row.append(k)
                entity.append(_own(found))
                word.append(np.unique(_words(text, found)[0]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), _lists(entity), _lists(word)], ["doc_id", "entities", "words"])


def _frequencies(bloom):
    def run(batches):
        chosen, parts = bloom.value, []

        def merged():
            u, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            return u, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                h, _, _, o = K.words(data, offsets)
                at = np.flatnonzero(chosen.has(h))
                h, r = h[at], K.row_of(o)[at]
                once = np.unique(h ^ K.mix(r.astype(np.uint64)), return_index=True)[1]
                parts.append(np.unique(h[once], return_counts=True))
                if sum(len(u) for u, _ in parts) > 1_000_000:
                    parts = [merged()]
        if parts:
            u, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(u)), pa.array(n)], ["word", "n"])

    return run


def revealing(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, entity, word, disclosure): of each document, the pairs from DISCLOSURE on. Of entities that stand in the very same documents, the least stands for all."""
    n = docs.count()
    row = F.monotonically_increasing_id().alias("row")
    mentions = scratch.save(docs.mapInArrow(_gathered, "doc_id long, entities array<long>, words array<long>").select(row, "*"), "mentions")
    words = scratch.save(mentions.select(F.explode("words").alias("word")).distinct(), "words")
    df = docs.select("text").mapInArrow(_frequencies(bloom_of(spark, words)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = mentions.select("row", F.explode("entities").alias("entity"))
    alike = held.groupBy("entity").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("row")).alias("same")).where(F.col("df") < n)
    held = scratch.save(held.join(alike.groupBy("same", "df").agg(F.min("entity").alias("entity")), "entity").select("row", "entity", "df"), "held")

    def within_reach(entity):  # a word's disclosure is at most log N / df(t) in units of IC(e)
        return F.log(F.lit(float(n)) / F.col("n")) >= (DISCLOSURE - 1e-6) * F.log(F.lit(float(n)) / F.col(entity))

    rare = mentions.select("row", "doc_id", F.explode("words").alias("word")).join(df, "word").join(held.groupBy("row").agg(F.max("df").alias("most")), "row").where(within_reach("most"))
    pairs = scratch.save(rare.drop("most").join(held, "row").where(within_reach("df")).select("doc_id", "entity", "word", "df", "n"), "pairs")
    counted = pairs.groupBy("entity", "word", "df", "n").agg(F.count("*").alias("c"))
    part = (F.col("c") + PRIOR * F.col("n") / n) / (F.col("df") + PRIOR)
    pmi = F.log(F.lit(float(n)) * part / F.col("n"))
    scored = counted.withColumn("disclosure", F.round(pmi / F.log(F.lit(float(n)) / F.col("df")), 6)).where(F.col("disclosure") >= DISCLOSURE)
    return scratch.save(pairs.select("doc_id", "entity", "word").distinct().join(scored.select("entity", "word", "disclosure"), ["entity", "word"]).select("doc_id", "entity", "word", "disclosure"), "revealing")


def sanitised(text: str, reveals) -> tuple[str, int, int]:
    """The text without its entities and the words for which reveals(entity, words) holds; how many there were of each. Word 0 asks whether the entity has any."""
    found = entities(text)
    if not found:
        return text, 0, 0
    cuts = {(s, e): f"[{kind}]" for s, e, kind, _ in found}
    own = [e for e in np.split(_own(found), np.arange(1, len(found))) if len(e) and np.any(reveals(e, np.zeros(1, np.uint64)))]
    terms = np.zeros((0, 2), np.int64)
    if own:
        words, spans = _words(text, found)
        terms = spans[np.logical_or.reduce([reveals(e, words) for e in own])]
    for s, e in terms.tolist():
        cuts[s, e] = "[NUMBER]" if text[s:e].isdigit() else ""
    parts, at = [], 0
    for (s, e), new in sorted(cuts.items()):
        before = text[at:s]
        if not new and before.endswith(" ") and (e == len(text) or not text[e].isalnum()):
            before = before[:-1]
        parts += [before, new]
        at = e
    return "".join(parts) + text[at:], len(found), len(terms)


_SCHEMA = "doc_id long, text string, n_entities long, n_terms long"


def _cleaned(pairs):
    def run(batches):
        for batch in batches:
            column = batch.column("text")
            texts, counts = column.to_pylist(), np.zeros((batch.num_rows, 2), np.int64)
            own = batch.column("pairs").to_pylist() if pairs is None else None
            for k in _suspects(column):
                known = pairs.value if own is None else np.array(sorted(set(own[k] or [])), np.int64)

                def reveals(entity, words, known=known):
                    h = _pair(entity, words).view(np.int64)
                    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

                texts[k], counts[k, 0], counts[k, 1] = sanitised(texts[k], reveals)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["doc_id", "text", "n_entities", "n_terms"])

    return run


def clean(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, text, n_entities, n_terms) of every row."""
    scratch = scratch or Scratch(spark)
    docs = docs.select("doc_id", "text")
    pairs = revealing(spark, docs, scratch)

    def hashed(batches):
        for batch in batches:
            e, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("entity", "word"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(K.signed(_pair(e, w)))], ["doc_id", "pair"])

    pairs = pairs.select("doc_id", "entity", F.explode(F.array("word", F.lit(0))).alias("word")).mapInArrow(hashed, "doc_id long, pair long")
    each = scratch.save(pairs.select("pair").distinct(), "hashes")
    if each.count() <= broadcast:
        known = np.sort(np.array([r["pair"] for r in each.toLocalIterator()], np.int64))
        return docs.mapInArrow(_cleaned(spark.sparkContext.broadcast(known)), _SCHEMA)

    by_doc = pairs.groupBy("doc_id").agg(F.collect_set("pair").alias("pairs")).withColumnRenamed("doc_id", "_llm_id")
    both = docs.join(by_doc.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("_llm_id")), "left").select("doc_id", "text", "pairs")
    return both.mapInArrow(_cleaned(None), _SCHEMA)


def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, table(spark, sf_dir, "documents"))
