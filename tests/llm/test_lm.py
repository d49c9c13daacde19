import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from twinbill.llm.lm import Folds, lm_scores, mixture_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _brute(rows):
    texts = [(i, [w.translate(LOWER) for w in WORD.findall(t or "")] + ["</s>"]) for i, t in rows]
    fold = [zlib.crc32(str(i).encode()) % 7 if i is not None else -1 for i, _ in texts]

    def counts(keep):
        words, pairs, contexts = Counter(), Counter(), Counter()
        for (_, t), f in zip(texts, fold, strict=True):
            if keep(f):
                before = ["<s>", *t[:-1]]
                words.update(t)
                pairs.update(zip(before, t, strict=True))
                contexts.update(before)
        return words, pairs, contexts, sum(words.values()), len(words)

    words, pairs, contexts, n, v = counts(lambda f: f not in (2, 5))
    seen = defaultdict(list)
    for (_, t), f in zip(texts, fold, strict=True):
        if f == 5:
            for u, w in zip(["<s>", *t[:-1]], t, strict=True):
                if contexts[u]:
                    seen[int(math.log2(contexts[u])) + 1].append((pairs[u, w] / contexts[u], (words[w] + 1) / (n + v + 1)))
    weight = {}
    for bucket, own in seen.items():
        x, lam = np.array(own), 0.5
        for _ in range(500):
            share = lam * x[:, 0] / (lam * x[:, 0] + (1 - lam) * x[:, 1])
            new = min(share.mean(), 1 - 1e-9)
            done, lam = abs(new - lam) < 1e-12, new
            if done:
                break
        weight[bucket] = lam
    words, pairs, contexts, n, v = counts(lambda f: f != 2)
    out = []
    for (i, t), f in zip(texts, fold, strict=True):
        base = score = 0.0
        for u, w in zip(["<s>", *t[:-1]], t, strict=True):
            alone = (words[w] + 1) / (n + v + 1)
            lam = weight.get(int(math.log2(contexts[u])) + 1, 0) if contexts[u] else 0
            base += math.log10(alone)
            score += math.log10(lam * pairs[u, w] / max(contexts[u], 1) + (1 - lam) * alone)
        out.append((i if i is not None else -1, f == 2, len(t), sum(words[w] > 0 for w in t), n, base, score))
    return sorted(out)


def _compare(df):
    expected = _brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in lm_scores(df).collect())
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g[:5] == e[:5]
        assert g[5] == pytest.approx(e[5], rel=1e-12)
        assert g[6] == pytest.approx(e[6], rel=1e-4)
    return expected


def test_table_against_counters(docs):
    rows = _compare(docs)
    held = [r for r in rows if r[1]]
    # On held-out texts the mixture beats the words alone.
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_odd_rows(spark, odd_docs, no_docs):
    _compare(odd_docs)
    assert lm_scores(no_docs).count() == 0
    none = spark.createDataFrame([(i, "a b") for i in range(200)], "doc_id long, text string")
    out = lm_scores(none.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert out and all(r.held_out and r.train_tokens == 0 and r.score <= 0 for r in out)


def test_weights_follow_the_better_estimate():
    weights = mixture_weights([(1, 256 * 4, 90), (1, -(1 << 30), 10), (2, -256 * 4, 50), (2, -(1 << 30), 50)])
    assert weights[1] > 0.5 > weights[2] >= 0
    assert weights[0] == 0 and weights[9] == 0
    assert Folds().tuning != Folds().held_out
