import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from twinbill.llm.pretokens import classes
from twinbill.llm.toxicity import Automaton, Tokens, ToxicityRule, fit, reject_toxic, score, toxicity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "moron", "scum", "stupid", "vequ~", "idiom"]
    automaton = Automaton(terms, 5)
    rng = random.Random(2)
    words = []
    for _ in range(8000):
        word = list(rng.choice([t.rstrip("~") for t in terms]))
        for _ in range(rng.randint(0, 2)):
            kind, at = rng.randint(0, 2), rng.randrange(len(word))
            word[at : at + 1] = [[], [word[at], rng.choice("idomtsx")], [rng.choice("idomtsx")]][kind]
        if word:
            words.append("".join(word))
    tokens = Tokens(pa.array([" ".join(words)]))
    assert [tokens.word(k) for k in range(len(tokens.starts))] == words
    which, value = automaton.hits(tokens)
    got = dict(zip(which.tolist(), value.tolist(), strict=True))
    for k, word in enumerate(words):
        found = []
        for n, term in enumerate(terms):
            if term.endswith("~"):
                found += [(0, 2 * n)] if word.startswith(term[:-1]) else []
            elif word == term:
                found.append((0, 2 * n))
            elif len(term) >= 5 and word[0] == term[0] and _distance(word[1:], term[1:]) == 1:
                found.append((1, 2 * n + 1))
        assert got.get(k, -1) == (min(found)[1] if found else -1), word


def test_words_and_quotation_marks():
    tokens = Tokens(pa.array(['He said "you IDIOT" twice', "“a” b", None, "*** st*pid!!", 'x "open\nnext']))
    words = [tokens.word(k) for k in range(len(tokens.starts))]
    assert words == ["he", "said", "you", "idiot", "twice", "a", "b", "st*pid", "x", "open", "next"]
    quoted = tokens.quoted(tokens.starts)
    assert [w for w, q in zip(words, quoted, strict=True) if q] == ["you", "idiot", "a", "open"]


def test_marks_at_the_ends_against_a_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1é*@$ .\n") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    tokens = Tokens(pa.array([*texts, "ab**", "**cd", "***", None]))
    got = [(tokens.row[k], tokens.word(k)) for k in range(len(tokens.starts))]
    inner = r"[ab1é](?:[ab1é*@$]*[ab1é])?"
    assert got == [(r, w) for r, t in enumerate([*texts, "ab", "cd"]) for w in re.findall(inner.replace("b1", "bcd1"), t)]


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker():
    """Tables of code points and words of a batch: each worker of an executor holds both at once."""
    classes.cache_clear()
    assert _peak(classes) < 40 << 20
    texts = pa.array(["he said $5 to me@here.org, " * 80] * 1000)  # about two million characters
    Tokens(texts[:1])
    assert _peak(lambda: Tokens(texts)) < 60 << 20


def _corpus(rng, n, start=0):
    docs, labels = [], []
    bad = ["slorgan", "mifterax", "quonterly"]
    for i in range(start, start + n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif rng.random() < 0.1:  # a report that quotes
            words.insert(rng.randrange(len(words)), f'"{rng.choice(bad)} {rng.choice(bad)}"')
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_learns_misspellings_and_quotation(spark):
    rng = random.Random(6)
    docs, labels = _corpus(rng, 900)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(df, lab)
    assert {t[:4] for t in model.terms} >= {"slor", "mift", "quon"}
    truth = dict(labels)
    out = toxicity(df, lab).collect()
    held = [r for r in out if r.held_out]
    assert 120 < len(held) < 240
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    probe = [
        (1, "w1 w2 slorgam w5 w6 mifteraxx w9 w3 quonterly w8"),  # misspelled
        (2, 'w1 w2 w3 w7 "slorgan mifterax" w5 w6 w9 w12'),  # quoted
        (3, "w1 w2 w3 w4 w5 w6"),
        (4, None),
    ]
    got = {r.doc_id: r for r in score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert [got[k].predicted for k in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_table_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    df, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity(df, lab).join(lab, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in out)
    assert right >= 0.94 * len(out)


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(9)
    docs, labels = _corpus(rng, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = toxicity(df, lab).where("held_out").select("doc_id").join(lab, "doc_id").selectExpr("doc_id", "1 - toxic toxic")
    other = lab.join(flipped, "doc_id", "left_anti").unionByName(flipped)
    assert sorted(toxicity(df, lab).collect()) == sorted(toxicity(df, other).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    lab = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 0), (4, 1), (6, 7)], "doc_id long, toxic int")
    out = toxicity(odd_docs, lab)
    assert out.count() == odd_docs.count()
    assert out.where("held_out is null or score is null").count() == 0
    kept = reject_toxic(odd_docs, lab)
    assert kept.schema == odd_docs.schema
    assert toxicity(no_docs, lab).count() == 0
    nothing = toxicity(odd_docs, lab.limit(0)).collect()
    assert len({r.score for r in nothing}) == 1
    assert ToxicityRule().terms > 0
