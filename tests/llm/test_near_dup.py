import random
import re

import pytest

from twinbill.llm import near_dup
from twinbill.llm.components import components
from twinbill.llm.near_dup import NearDup, keep_first, near_duplicates


def _set(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def _expected(rows, width):
    """Brute force over all pairs of different texts; one id may have several texts."""
    sets = [(i, _set(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def _compare(df, width):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = near_duplicates(df, NearDup(width=width)).collect()
    expected = _expected(rows, width)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in out) == sorted((i or -1, len(_set(t, width))) for i, t in rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("width", [2, 5])
def test_table_against_all_pairs(docs, width):
    _compare(docs, width)


@pytest.mark.parametrize("cell", [3, near_dup.CELL])
def test_links_that_miss_the_smallest_member(spark, monkeypatch, cell):
    """Chains and stars whose centre is not the smallest id, with many copies at the edge of the threshold."""
    monkeypatch.setattr(near_dup, "CELL", cell)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = rng.choices(vocabulary, k=200)
    rows = [(900, " ".join(base))]
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(200), rng.randint(4, 16)):
            own[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    chain = rng.choices(vocabulary, k=120)
    for i in range(25):  # each differs a little more from the first
        chain = chain[4:] + rng.choices(vocabulary, k=4)
        rows.append((300 - i, " ".join(chain)))
    _compare(spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_odd_rows(odd_docs, no_docs):
    _compare(odd_docs, 2)
    assert near_duplicates(no_docs).count() == 0
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id or -1) for r in kept.select("doc_id").collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 4, 5, 5, 6]


def test_sketch_lets_pairs_at_the_threshold_pass():
    rule = NearDup()
    assert 0 < rule.most_odd_bits < rule.sketch_bits / 2


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)]
    links += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(None, 3), (7, 7)]
    parent = {x: x for link in links if None not in link and link[0] != link[1] for x in link}
    for _ in range(100):
        for a, b in links:
            if a is not None and a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.id: r.component for r in got} == parent and len(got) == len(parent)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
