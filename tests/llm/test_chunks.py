import random
import re

import numpy as np

from twinbill.llm.chunks import Chunking, cuts, substring_dedup

WORD_START = re.compile(rb"(?:^|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D]")


def _pieces(data, rule):
    if not data:
        return []
    starts = cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), rule).tolist()
    return [(a, b) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]


def _brute(rows, rule=Chunking()):
    first, out = {}, []
    chunks = [(i, (t or "").encode()) for i, t in rows]
    for i, data in chunks:
        for a, b in _pieces(data, rule):
            if i is not None:
                first[data[a:b]] = min(i, first.get(data[a:b], i))
    for i, data in chunks:
        own = _pieces(data, rule)
        again = [i is not None and first[data[a:b]] < i for a, b in own]
        word = {m.end() - 1 for m in WORD_START.finditer(data)}
        kept, k = b"", 0
        while k < len(own):
            end = k + 1
            while again[k] and end < len(own) and again[end]:
                end += 1
            a, b = own[k][0], own[end - 1][1]
            if not again[k] or sum(p in word for p in range(a, b)) < rule.min_words:
                kept += data[a:b]
            k = end
        out.append((i if i is not None else -1, kept.decode()))
    return sorted(out)


def _compare(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = substring_dedup(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out) == _brute(rows)
    return out


def test_cuts_resist_insertions():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(2000)]
    a = " ".join(words).encode()
    b = " ".join([*words[:1000], "inserted", "words", *words[1000:]]).encode()
    rule = Chunking()
    one, two = ({data[x:y] for x, y in _pieces(data, rule)} for data in (a, b))
    assert len(one - two) <= 4
    sizes = [y - x for x, y in _pieces(a, rule)]
    assert 24 < np.mean(sizes) < 48 and max(sizes) <= rule.longest


def test_texts_do_not_influence_each_other():
    rng = random.Random(2)
    texts = [("é中x " * rng.randint(0, 60) + str(rng.random())).encode() for _ in range(50)] + [b"", b"a" * 5000]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = cuts(np.frombuffer(b"".join(texts), np.uint8), offsets, Chunking())
    alone = [offsets[k] + a for k, t in enumerate(texts) for a, _ in _pieces(t, Chunking())]
    assert together.tolist() == sorted(alone)
    for k, t in enumerate(texts):
        for a, b in _pieces(t, Chunking()):
            t[a:b].decode()  # no character is cut


def test_table_against_brute_force(docs):
    _compare(docs)


def test_planted_passages_are_caught(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 30000)}" for _ in range(n))
    passages = [text(51) for _ in range(30)]
    rows, planted = [], set()
    for i in range(400):
        body = text(rng.randint(0, 200))
        if i % 3 == 0:
            k = (i // 3) % 30
            planted |= {i} if i >= 90 else set()
            body = f"{body} {passages[k]} {text(rng.randint(0, 60))}"
        rows.append((i, body))
    out = _compare(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out if r.removed_bytes} == planted


def test_odd_rows(odd_docs, no_docs):
    _compare(odd_docs)
    assert substring_dedup(no_docs).count() == 0
