"""Token counts by byte-pair encoding, with huge documents encoded in overlapping chunks that are resynchronised.

A text of more than CHUNK characters is cut into chunks that overlap by OVERLAP characters. Each is encoded by itself, with the byte offsets of its
tokens. Two neighbours are spliced at a boundary that is *proven* stable. The pattern that splits text before the merges is matched from left to right, its
pieces cover all of the text, and merges never cross pieces; so wherever no alternative of it can span two neighbouring characters, a piece ends and one
begins, whatever stands before or after. That is so between a character that isn't space and one that is, and between any two of letters, numbers and other
marks, but for a letter after an apostrophe. The boundary must also be one of tokens in both encodings, and both must agree on the tokens from there to the
last stable boundary of the overlap. Where no boundary of the overlap passes, the overlap is doubled and the right chunk encoded anew; when it reaches back
over the whole left chunk, the left one is encoded anew at double its length. Lengths so double at each failure, and the work stays in proportion to the
text, also where it has no boundary at all.

Defined results: null and empty texts have no tokens, and no chunks; an empty table has no rows. Strings that look like special tokens are ordinary text. Every
row is counted, repeated ones too; doc_id may be null. Other columns, of whatever names, aren't read. There are no ties to break. The vocabulary's path is a
parameter: the file lies there on every machine, or is sent along with SparkContext.addFile and named by its base name.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import table, workers_import

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 16_384, 256
BLANKS = 100_000
BLANK = regex.compile(rf"(?<!\s)\s{{{BLANKS},}}+")
STABLE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of ranks, and the byte length of each token."""
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def tokens(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """The tokens of a text. The matcher backtracks over runs of spaces and gives up on those of a million, so long runs are made pieces here: all of the run
    but its last space, which the pattern leaves to what follows, or the whole run at the end."""
    if len(text) <= BLANKS:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for m in BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += encoding.encode_ordinary(text[at : m.start()]) + encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def _offsets(text: str, encoding: tiktoken.Encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(tokens(text, encoding), np.int64)
    return ids, np.concatenate([[0], np.cumsum(lengths[ids])])


def _bytes_before(text: str) -> np.ndarray:
    """For each character of a text and its end, the bytes before it."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), dtype=np.int64)])


def _splice(text: str, at: int, left: tuple, right: tuple, left_start: int, end: int) -> tuple[int, int, int] | None:
    """For chunks of which the right starts at at and the left ends at end: tokens of the left before the splice, of the right before it, and its place."""
    stable = [m.start() for m in STABLE.finditer(text, at, end) if at < m.start() < end - 1]
    if not stable:
        return None
    before = _bytes_before(text[left_start:end])
    places = before[np.array(stable) - left_start]
    base = before[at - left_start]
    i, j = np.searchsorted(left[1], places), np.searchsorted(right[1], places - base)
    ok = np.flatnonzero((left[1][np.minimum(i, len(left[1]) - 1)] == places) & (right[1][np.minimum(j, len(right[1]) - 1)] == places - base))
    if not len(ok):
        return None
    # the tokens between the first passing boundary and the last agree from the last difference on, which is looked for once
    last = ok[-1]
    n = int(min(i[last] - i[ok[0]], j[last] - j[ok[0]]))
    differ = np.flatnonzero(left[0][i[last] - n : i[last]] != right[0][j[last] - n : j[last]])
    since = int(differ[-1]) + 1 - n if len(differ) else -n
    agree = ok[(i[ok] >= i[last] + since) & (i[last] - i[ok] == j[last] - j[ok])]
    k = min(agree, key=lambda k: abs(k - len(stable) // 2))
    return int(i[k]), int(j[k]), stable[k]


def encode(text: str, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int, int]:
    """The tokens of a text, the chunks that it took, and how often an overlap was widened."""
    encoding, lengths = encoder(path)
    if len(text) <= chunk:
        return np.array(tokens(text, encoding), np.int64), int(bool(text)), 0
    parts, chunks, widened = [], 1, 0
    start, end = 0, chunk
    left, skip = _offsets(text[:chunk], encoding, lengths), 0
    while end < len(text):
        until, wide, found = min(len(text), end + chunk - overlap), overlap, None
        while found is None and end - wide > start:
            at = end - wide
            right = _offsets(text[at:until], encoding, lengths)
            found = _splice(text, at, left, right, start, end)
            if found is not None and found[0] < skip:
                found = None
            if found is None:
                wide, widened = wide * 2, widened + 1
        if found is None:  # nothing in the whole left chunk is stable: it becomes twice as long
            end = min(len(text), max(until, start + 2 * (end - start)))
            left = _offsets(text[start:end], encoding, lengths)
            continue
        parts.append(left[0][skip : found[0]])
        left, skip, start, end, chunks = right, found[1], at, until, chunks + 1
    return np.concatenate([*parts, left[0][skip:]]), chunks, widened


def counted(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, n_chunks and n_widened of every row."""

    def run(batches):
        encoding, _ = encoder(path)
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text and len(text) <= chunk:
                    out[k] = len(tokens(text, encoding)), 1, 0
                elif text:
                    ids, chunks, widened = encode(text, path, chunk, overlap)
                    out[k] = len(ids), chunks, widened
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[:, k]) for k in range(3))], ["doc_id", "n_tokens", "n_chunks", "n_widened"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_chunks long, n_widened long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import(spark)
    return counted(table(spark, sf_dir, "documents"))
