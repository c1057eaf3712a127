import random
import re

import numpy as np
import pyarrow as pa

from timelineql.llm import kernel as K

WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
TEXTS = ["", None, "Ab, ab!ab", "x", " ", "ñandú ß\nA1-b2", "ab", "Ab ab"]


def test_words_match_a_regex_in_any_blocks():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aB1 ,.\né") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for limit in (1, 50, 1 << 20):
        got = {}
        for a, data, offsets in K.blocks(pa.array(texts), limit=limit):
            h, s, e, o = K.words(data, offsets)
            for i in range(len(offsets) - 1):
                got[a + i] = [(int(h[k]), bytes(data[s[k] : e[k]]).decode()) for k in range(o[i], o[i + 1])]
        for i, t in enumerate(texts):
            want = WORD.findall((t or "").lower())
            assert [w for _, w in got[i]] == want
            assert [h for h, _ in got[i]] == [K.word_hash(w) for w in want]


def test_slices_of_arrays_and_powers_beyond_a_block():
    a = pa.array(["zz", "Ab", None, "cd"])[1:]
    assert [(x, bytes(d)) for x, d, _ in K.blocks(a)] == [(0, b"abcd")]
    long = "q" * 5_000_000
    (_, data, offsets), = K.blocks(pa.array([long]))
    assert len(K.words(data, offsets)[0]) == 1


def test_sequences():
    h = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    s = K.sequence_sums(h)
    at = np.arange(5)
    g = K.span_hash(s, at, at + 2)
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3
