import random

import numpy as np

from twinbill.llm.benchmark import Alignment, contamination, decontaminate, local_alignment


def _smith_waterman(a, b, rule):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = rule.match if a[i - 1] == b[j - 1] else rule.mismatch
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] + rule.gap, table[i][j - 1] + rule.gap)
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_full_table():
    rng = random.Random(3)
    for rule in (Alignment(), Alignment(match=3, mismatch=-2, gap=-1)):
        for _ in range(300):
            a = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))], np.uint64)
            b = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 20))], np.uint64)
            score, start, end = local_alignment(a, b, rule)
            assert score == _smith_waterman(a, b, rule)
            assert score == _smith_waterman(a, b[start:end], rule)


def _words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def test_exact_and_edited_copies(spark):
    rng = random.Random(8)
    items = [(k, " ".join(_words(rng, rng.randint(12, 50)))) for k in range(40)] + [(None, "no id"), (77, None), (78, "")]
    docs, expected = [], set()
    for i in range(200):
        text = _words(rng, rng.randint(0, 300))
        if i % 3 == 0:
            k = rng.randrange(40)
            copy = items[k][1].upper().split() if i % 2 else items[k][1].split()
            for _ in range(len(copy) // 8):  # change, drop, insert
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["zz"], [], [copy[at], "yy"]])
            text = [*text, *copy, *_words(rng, 20)]
            expected.add((i, k))
        docs.append((i, " ".join(text)))
    docs += [(500 + k, "x " + items[0][1]) for k in range(100)]  # a third of the corpus holds one item
    expected |= {(500 + k, 0) for k in range(100)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected
    for r in out:
        span = dict(docs)[r.doc_id].lower().split()[r.start_word : r.end_word]
        own = set(dict(items)[r.item_id].split())
        assert sum(w in own for w in span) >= 0.6 * len(span)
    assert decontaminate(df, bench).count() == len(docs) - len({d for d, _ in expected})
    # Blocks of one item each give the same.
    small = contamination(df, bench, Alignment(block_bytes=1)).collect()
    assert sorted(small) == sorted(out)


def test_seeds_miss_nothing_that_full_alignment_finds(spark, docs):
    """Brute force on the table: every (document, item) with a share of common words is aligned in full."""
    from twinbill.llm.text import Words
    import pyarrow as pa

    rule = Alignment()
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: Words(pa.array([r.text])).hash for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        text = Words(pa.array([r.text])).hash
        for k, item in items.items():
            # The score cannot reach the bar with fewer common words.
            if rule.match * np.isin(item, text).sum() >= rule.coverage * rule.match * len(item):
                if local_alignment(item, text, rule)[0] >= rule.coverage * rule.match * len(item):
                    expected.add((r.doc_id, k))
    assert {(r.doc_id, r.item_id) for r in contamination(docs, bench).collect()} == expected


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "three four five six seven"), (2, "a")], "item_id long, text string")
    out = contamination(odd_docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in out) == [(-1, 1), (4, 1), (4, 1)]
    kept = decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert contamination(no_docs, bench).count() == 0
    assert contamination(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
