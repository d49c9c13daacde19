import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex

from twinbill.llm.language_id import (
    LanguageModel,
    LanguageRule,
    _least_score,
    _temperature,
    fit,
    languages,
    predict,
    softmax,
    subwords,
)
from twinbill.llm.queries import op11_language_id
from twinbill.llm.text import hash_spans, mix

MEDIUM = "/root/testdata/sf0.01"
SMALL_RULE = LanguageRule(sample_rows=400, updates=100)


def plain_subwords(text, buckets):
    """Buckets of one text, one subword after the other."""
    words = regex.sub(r"\P{L}+", " ", (text or "").lower()).strip(" ")
    raw = f" {words} ".encode()
    out = Counter()
    for k in (1, 2, 3):
        for at in range(len(raw) - k):
            run = raw[at : at + k + 1]
            if b" " not in run[1:k] and not (run[0] == 32 == run[1]):
                value = np.uint64(int.from_bytes(run, "little")) + (np.uint64(k) << np.uint64(40))
                out[int(mix(np.array([value]))[0] % np.uint64(buckets))] += 1
    for word in words.split():
        data = np.frombuffer(word.encode(), np.uint8)
        out[int(hash_spans(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(buckets))] += 1
    return out


def test_subwords_equal_a_plain_loop(monkeypatch):
    texts = ["Élan vital, d'être!", "", None, "a", "1234 --", "日本語 text", "x" * 50, "the cat\nthe cat", " Straße ÜBER "]
    for window in (1 << 20, 7):
        monkeypatch.setattr("twinbill.llm.language_id.WINDOW", window)
        found = [Counter() for _ in texts]
        for bucket, owner in subwords(pa.array(texts, pa.string()), 1 << 16):
            for b, o in zip(bucket.tolist(), owner.tolist(), strict=True):
                found[o][b] += 1
        assert found == [plain_subwords(t, 1 << 16) for t in texts]


def test_held_out_accuracy_and_calibration(spark):
    out = op11_language_id(spark, MEDIUM)
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").toPandas()
    assert len(rows) == truth.count() and rows["score"].between(0, 1).all()
    assert [h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(rows["doc_id"], rows["held_out"], strict=True)].count(False) == 0
    held = rows[rows["held_out"]]
    right = held["lang"] == held["lang_pred"]
    for lang, part in held.groupby("lang"):
        assert (part["lang_pred"] == lang).mean() > 0.95, lang
    assert right.mean() > 0.98
    # the score says how often the answer is right
    assert abs(held["score"].mean() - right.mean()) < 0.03
    accepted = held[~held["rejected"]]
    assert len(accepted) > 0.9 * len(held) and (accepted["lang"] == accepted["lang_pred"]).mean() >= 0.985


def test_held_out_rows_ids_and_labels_teach_nothing(spark):
    ids = [i for i in range(900)]
    text = {"aa": "lorem ipsum dolor", "bb": "quick brown foxes"}
    docs = [(i, text["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb") for i in ids]
    # the held-out third carries labels that are all wrong, and a language of its own
    lies = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in docs]
    df = spark.createDataFrame(lies, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in languages(df, SMALL_RULE).collect()}
    assert all(out[i] == lang for i, _, lang in docs)


def test_foreign_text_scores_lower(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = fit(df)
    known = predict(df, model).toPandas()["score"].mean()
    odd = spark.createDataFrame([(k, w) for k, w in enumerate(["zzyq xkcd qwx", "пример текста", "漢字仮名"])], "doc_id long, text string")
    got = predict(odd, model).toPandas()
    assert (got["score"] < known).all() and set(got["lang_pred"]) <= set(model.names)


def test_odd_input(spark, odd_docs, no_docs):
    plain = odd_docs.selectExpr("*", "if(id = 9, 'en', null) as lang", "7 as score", "'x' as lang_pred", "true as held_out")
    out = languages(plain, SMALL_RULE).toPandas()
    assert len(out) == odd_docs.count() and out["doc_id"].isna().sum() == 2
    by_id = out.set_index("doc_id")
    for empty in (1, 2, 3):
        assert by_id.loc[empty, "lang_pred"] == "und" and by_id.loc[empty, "score"] == 0 and by_id.loc[empty, "rejected"]
    assert by_id.loc[6, "lang_pred"] == "en" and set(out["lang_pred"]) == {"en", "und"}
    assert languages(no_docs, SMALL_RULE).count() == 0
    blank = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in languages(blank, SMALL_RULE).collect()} == {("und", 0.0, True)}


def test_temperature_and_rejection_rule():
    rng = np.random.default_rng(2)
    true = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in softmax(true)])
    assert abs(_temperature(true * 3, labels, np.ones(4000)) - 3) < 0.4
    score, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([1, 1, 1, 0, 1])
    assert _least_score(score, right, np.ones(5), 1.0) == 0.8
    assert _least_score(score, right, np.ones(5), 0.8) == 0.6
    assert _least_score(score, right * 0, np.ones(5), 0.8) > 1
    assert LanguageModel(SMALL_RULE).names == []
