import hashlib
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinbill.functions.similarity import ratios, similarity, similarity_bound
from twinbill.functions.text import (
    ascii_upper,
    digit_signature,
    normalize_identifier,
    safe_reference,
    strip_whitespace,
)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_documented_values(spark):
    assert one(spark, ascii_upper(F.lit("İşlem-çağrı"))) == "ISLEM-CAGRI"
    assert one(spark, normalize_identifier(F.lit(" inv-100 / A "))) == "INV100A"
    assert one(spark, digit_signature(F.lit("INV-20-A-004"))) == "20004"
    assert one(spark, ascii_upper(F.lit(None).cast("string"))) is None


def test_reference_is_stable_and_depends_on_the_pepper(spark):
    first = one(spark, safe_reference(F.lit("SUP-SECRET"), "pepper"))
    assert first == one(spark, safe_reference(F.lit("SUP-SECRET"), "pepper"))
    assert first != one(spark, safe_reference(F.lit("SUP-SECRET"), "other"))
    assert first == "ref_" + hashlib.sha256(b"pepper:SUP-SECRET").hexdigest()[:12]
    assert "SECRET" not in first


def test_normalisation_of_every_character(spark):
    """The native path agrees with the Unicode rule on all of Unicode."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a-" + "".join(chars[i : i + 50]) + "z" for i in range(0, len(chars), 50)]

    def fold(text):
        parts = unicodedata.normalize("NFKD", text)
        return "".join(c for c in parts if not unicodedata.combining(c)).upper()

    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select("t", normalize_identifier(F.col("t")).alias("n"), ascii_upper(F.col("t")).alias("u"))
        .collect()
    )
    for row in rows:
        assert row["u"] == fold(row["t"])
        assert row["n"] == re.sub("[^A-Z0-9]+", "", fold(row["t"]))


def test_strip_removes_unicode_space(spark):
    assert one(spark, strip_whitespace(F.lit("\t  x y  \n"))) == "x y"


def check(pairs):
    left, right = zip(*pairs)
    got = ratios(pa.array(left, pa.string()), pa.array(right, pa.string()))
    for (a, b), value in zip(pairs, got):
        assert value == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_pieces_are_read_where_the_texts_lie(monkeypatch):
    import numpy as np

    from twinbill.functions import similarity as S

    copied = []
    monkeypatch.setattr(np, "take_along_axis", lambda *a, **k: copied.append(a))
    texts = ["INV000100012345", "INV000100021354", "AB", "B", "XAYBZ", "ZBYAX"]
    buffer = np.frombuffer("".join(texts).encode(), np.uint8)
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    left, right = zip(*[(a, b) for a in range(6) for b in range(6)], strict=True)
    a, b = np.array(left), np.array(right)
    got = S._matched(buffer, start[a], length[a], buffer, start[b], length[b])
    ratio = [SequenceMatcher(None, texts[x], texts[y]).ratio() for x, y in zip(left, right, strict=True)]
    assert np.allclose(2 * got / (length[a] + length[b]), ratio, rtol=0, atol=1e-12)
    assert not copied


def test_similarity_depends_on_order():
    check([("TIDE", "DIET"), ("DIET", "TIDE"), ("", ""), ("", "A"), ("INV100", "INV999")])
    values = ratios(pa.array(["TIDE", "DIET", None]), pa.array(["DIET", "TIDE", "X"]))
    assert list(values[:2]) == [0.25, 0.5] and values[2] != values[2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("AB01", max_size=30), st.text("AB01", max_size=30)), min_size=1))
def test_similarity_of_short_texts(pairs):
    check(pairs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=20), st.text(max_size=20)), min_size=1))
def test_similarity_of_any_text(pairs):
    check(pairs)


def test_similarity_of_long_texts():
    """Lengths on both sides of the popular-character rule and of 8-bit codes."""
    rng = random.Random(5)
    lengths = [150, 198, 199, 200, 201, 254, 255, 256, 300]
    pairs = []
    for alphabet in ("AB", "ABCDEFGHIJ", "A"):
        for la in lengths:
            for lb in lengths:
                pairs.append(
                    (
                        "".join(rng.choice(alphabet) for _ in range(la)),
                        "".join(rng.choice(alphabet) for _ in range(lb)),
                    )
                )
    check(pairs)


def test_similarity_column_settles_equal_and_empty_texts(spark):
    long = "AB" * 120
    rows = [("", "", 1.0), ("", "A", 0.0), (long, long, 1.0), ("TIDE", "DIET", 0.25)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(similarity(a, b).alias("s"), similarity_bound(a, b).alias("u")).collect()
    for (left, right, expected), row in zip(rows, got):
        assert row["s"] == expected == SequenceMatcher(None, left, right).ratio()
        assert row["u"] >= row["s"]


def test_multiset_bound_holds_and_is_tighter(spark):
    import random

    from twinbill.functions.similarity import marks, multiset_bound

    rng = random.Random(5)
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["", "A", "9", "INV100", "0" * 40, "9" * 30 + "Z" * 30, letters, letters[::-1] * 2]
    texts += ["".join(rng.choices(letters[: rng.choice([2, 12, 36])], k=rng.randint(0, 60))) for _ in range(60)]
    rows = [(x, y) for x in texts for y in texts]
    df = spark.createDataFrame(rows, "a string, b string").withColumns(
        {side: marks(F.col(name)) for side, name in (("ma", "a"), ("mb", "b"))}
    )
    a, b, ma, mb = (F.col(c) for c in ("a", "b", "ma", "mb"))
    digits = [F.regexp_replace(c, "[^0-9]", "") for c in (a, b)]
    got = df.select(
        "a", "b",
        multiset_bound(a, b, ma, mb).alias("u"),
        multiset_bound(*digits, ma, mb, digits_only=True).alias("d"),
        similarity_bound(a, b).alias("length"),
    ).collect()
    from collections import Counter
    from difflib import SequenceMatcher

    def shared(x, y):
        return 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y)) if x or y else 1.0

    for r in got:
        x, y = ("".join(c for c in t if c.isdigit()) for t in (r["a"], r["b"]))
        assert r["u"] >= shared(r["a"], r["b"]) - 1e-12 and r["d"] >= shared(x, y) - 1e-12
        assert r["u"] >= SequenceMatcher(None, r["a"], r["b"]).ratio() - 1e-12
        if max(Counter(r["a"] + r["b"]).values(), default=0) <= 7:
            assert abs(r["u"] - shared(r["a"], r["b"])) < 1e-12 and r["u"] <= r["length"] + 1e-12


def test_fewer_pairs_reach_the_udf(ledger):
    from tests.test_model import MODEL
    from twinbill.functions.similarity import similarity_bound as by_length
    from twinbill.operators import blocking as B
    from twinbill.operators import scoring as SC

    pairs = B.band_pairs(B.prepare(ledger), max_days=60)
    after = pairs.filter(SC.may_reach(MODEL)).count()

    def length_only(name):
        return by_length(F.col(f"left_{name}"), F.col(f"right_{name}"))

    tight, SC.text_bound = SC.text_bound, length_only
    try:
        before = pairs.filter(SC.may_reach(MODEL)).count()
    finally:
        SC.text_bound = tight
    assert after < 0.8 * before
    print(f"pairs that reach the similarity: {before} before, {after} after")


def test_block_matching_in_groups(monkeypatch):
    """Many pairs of mixed lengths and alphabets, in one group and in many; edited copies among them."""
    from twinbill.functions import block_matching as BM

    rng = random.Random(9)
    pairs = []
    for _ in range(150):
        alphabet = rng.choice(["AB", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "åäö中文字🙂 ab", "".join(map(chr, range(100, 700)))])
        a, b = ("".join(rng.choices(alphabet, k=rng.choice([0, 1, 30, 199, 200, 201, 450]))) for _ in range(2))
        if rng.random() < 0.5 and a:
            cut = rng.randrange(len(a))
            b = a[cut:] + rng.choice(alphabet) + a[:cut]
        pairs.append((a, b))
    expected = [sum(m.size for m in SequenceMatcher(None, *p).get_matching_blocks()) for p in pairs]
    left, right = ([p[k] for p in pairs] for k in (0, 1))
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(BM, "GROUP", size)
        assert BM.matched_characters(left, right).tolist() == expected
    assert BM.matched_characters([], []).tolist() == []


def test_fold_of_every_code_point_without_python(spark):
    import unicodedata

    def fold(text):
        base = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return "".join(base).upper()

    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(k, "".join(points[k : k + 64])) for k in range(0, len(points), 64)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = df.select("t", ascii_upper(F.col("t")).alias("u"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in got.collect():
        assert r["u"] == fold(r["t"])
    assert spark.range(1).select(ascii_upper(F.lit(None).cast("string")).alias("u")).first()["u"] is None


def test_marks_count_whole_batches():
    """Unary counts up to seven, the rest added up; slices, empty texts, NULL and other characters."""
    from twinbill.functions.similarity import counted_marks

    texts = pa.array(["zz", "A0", "", None, "9" * 10 + "B" * 9, "\u00e9a-A"], pa.string()).slice(1)
    empty = {"w0": 0, "w1": 0, "w2": 0, "w3": 0, "digits_beyond": 0, "letters_beyond": 0}
    assert counted_marks(texts).to_pylist() == [
        empty | {"w0": 1, "w1": 1 << 7},
        empty,
        None,
        empty | {"w1": 127 | 127 << 14, "digits_beyond": 3, "letters_beyond": 2},
        empty | {"w1": 1 << 7},
    ]


def test_marks_replace_no_text(spark):
    """A replacement for each character took most of the time of the pair step."""
    from twinbill.functions.similarity import marks

    rows = spark.createDataFrame([("AB7",), (None,)], "text string").select("text", marks(F.col("text")).alias("m"))
    assert "replace(" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["m"]["w0"] for r in rows.orderBy(F.desc("text")).collect()] == [1 << 49, 0]
