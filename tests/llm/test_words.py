import random
import re

import numpy as np
import pyarrow as pa

from twinbill.llm.pretokens import classes, pretokens
from twinbill.llm.text import Words, column_bytes, shingles, steps

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _random_texts(seed, n):
    rng = random.Random(seed)
    pieces = ["a", "B", "ab ", " ", "\n", "\t\x0b", "É", "中", "🙂", "\x1c", " ", "long" * 9, "'s", ""]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(n)]


def test_words_and_hashes_match_a_regular_expression():
    texts = [*_random_texts(1, 400), None, "", "x" * 50_000]
    words = Words(pa.array(texts))
    expected = [[w.lower() for w in WORD.findall((t or "").encode())] for t in texts]
    assert np.diff(words.first).tolist() == [len(e) for e in expected]
    seen = {}
    for word, h in zip([w for e in expected for w in e], words.hash.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_steps_keep_all_rows_in_order():
    batch = pa.record_batch([pa.array(range(300)), pa.array([None, "", "z" * 100_000] * 100)], names=["k", "text"])
    parts = list(steps(iter([batch])))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(300))
    assert len(parts) > 1
    assert list(steps(iter([batch.slice(0, 0)]))) == []


def test_sliced_columns():
    column = pa.array(["aa", "bb", None, "cc"]).slice(1, 3)
    raw, offsets = column_bytes(column)
    assert raw.tobytes() == b"bbcc" and offsets.tolist() == [0, 2, 2, 4]


def test_shingles():
    w = Words(pa.array(["a b a b a", "a b", "a", ""]))
    assert [len(shingles(w.of(k), 2)) for k in range(4)] == [2, 1, 1, 0]
    assert shingles(w.of(1), 2)[0] in shingles(w.of(0), 2)


def test_pretokens_match_the_public_pattern():
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(5)
    pieces = ["a", "é", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "1", "²", "!", "...", "中", "🙂", "　", "_", "s"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(3000)]
    raw, offsets = column_bytes(pa.array(texts))
    starts, ends = pretokens(raw, offsets)
    got = [raw[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
    assert got == [t for text in texts for t in pattern.findall(text)]
    assert classes()[ord("a")] == 1
