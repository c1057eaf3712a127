import random

import pytest

from timelineql.llm import token_counts as T

TEXTS = ["a" * 5000, "x y" * 2000, " " * 3000, "日本語" * 1000, "12 34 " * 900, "don't it's " * 500, "a\n\n  b " * 700, "<|endoftext|> the " * 300, "ab" * 300 + " cd " * 400]


@pytest.mark.parametrize("chunk,overlap", [(200, 64), (500, 40), (1000, 8)])
def test_splices_equal_whole_encodings(chunk, overlap):
    rng = random.Random(3)
    encoding, _ = T.encoder(T.VOCABULARY)
    texts = TEXTS + ["".join(rng.choice(["the", " ", " of", "\n", "é", "12", ".", "ing", "  ", "'s"]) for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    for t in texts:
        ids, chunks, _ = T.encode(t, chunk=chunk, overlap=overlap)
        assert ids.tolist() == encoding.encode_ordinary(t) and (chunks > 1) <= (len(t) > chunk)


def test_overlaps_are_widened_until_something_is_stable():
    text = "one two three " * 40 + "x" * 700 + " four five six" * 40
    ids, chunks, widened = T.encode(text, chunk=600, overlap=16)
    assert widened > 0 and chunks > 1 and ids.tolist() == T.encoder(T.VOCABULARY)[0].encode_ordinary(text)


def test_table(spark, odd, none):
    encoding, _ = T.encoder(T.VOCABULARY)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in T.counted(odd, chunk=1000).collect())
    assert got == sorted((str(r["doc_id"]), len(encoding.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert T.counted(none).count() == 0


@pytest.mark.parametrize("text", ["日本語のテキストは分かち書きをしない。" * 200_000, "日本語" * 100_000, "Ab0+/9zQ" * 100_000, " " * 1_100_000, "a" + "\n" * 1_100_000 + "b c", "x" * 700_000, ("word " * 40 + " " * 150_000 + "\n") * 2])
def test_long_texts_take_time_in_proportion(text):
    """Without spaces, without any boundary, and with more blanks in a row than the pattern's matcher bears."""
    import time

    encoding, _ = T.encoder(T.VOCABULARY)
    began = time.process_time()
    whole = T.tokens(text, encoding)
    once = time.process_time() - began
    began = time.process_time()
    ids, _, _ = T.encode(text)
    assert ids.tolist() == whole
    assert time.process_time() - began < 12 * once + 8


def test_blank_runs_as_the_pattern_takes_them(monkeypatch):
    encoding, _ = T.encoder(T.VOCABULARY)
    monkeypatch.setattr(T, "BLANKS", 5)
    monkeypatch.setattr(T, "BLANK", T.regex.compile(r"(?<!\s)\s{5,}+"))
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", " ", "  ", "\n", "\t", "     ", "1", "."]) for _ in range(rng.randint(6, 40)))
        assert T.tokens(t, encoding) == encoding.encode_ordinary(t), repr(t)
