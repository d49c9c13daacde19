import re
from collections import Counter
from math import floor, log

from twinbill.llm.queries import op12_ranked_lexical_search
from twinbill.llm.ranked_search import Ranking, ranked_search

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, depth=20):
    bags = [(i, Counter(terms(text))) for i, text in docs]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    total, every = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for item, text in sorted({(i, t) for i, t in items if i is not None and t}):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, uses in asked.items():
        scores = []
        for i, bag, n in bags:
            m = 75 + (25 * n * total) // every
            score = sum(
                q * floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t, q in uses.items()
                if t in bag
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:depth], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=lambda r: r[:2])


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda r: r[:2])


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    assert rows(op12_ranked_lexical_search(spark, SMALL)) == brute([tuple(r) for r in docs], [tuple(r) for r in items])


def test_large_classes_ties_and_blocks(spark):
    """More copies than an item may get, equal scores of unequal bags, and one block for each item or two."""
    docs = [(1000 - k, "red blue") for k in range(60)] + [(k, "Blue, red!") for k in range(5)]
    docs += [(2000 + k, f"green x{k}") for k in range(40)] + [(3000 + k, "other words entirely") for k in range(200)]
    items = [(1, "red"), (2, "green green blue"), (3, "x1 x2 red"), (4, "absent"), (5, "words")]
    schema = "doc_id long, text string"
    d = spark.createDataFrame(docs, schema).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert {r[0] for r in expected} == {1, 2, 3, 5} and [r[2] for r in expected[:6]] == [0, 1, 2, 3, 4, 941]
    assert rows(ranked_search(d, q)) == expected
    assert rows(ranked_search(d, q, Ranking(block_bytes=8))) == expected
    assert rows(ranked_search(d, q, Ranking(depth=3))) == brute(docs, items, 3)


def test_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "three FOUR", 1), (1, "three FOUR", 2), (2, None, 1), (None, "word", 1), (3, "word naïve", 1), (3, "中文 word", 1), (4, " ", 1)],
        "item_id long, text string, rank int",
    )
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    assert rows(ranked_search(odd_docs, items)) == brute(docs, asked)
    assert rows(ranked_search(no_docs, items)) == []
    assert rows(ranked_search(odd_docs, items.limit(0))) == []
