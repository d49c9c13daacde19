import hashlib
import random

from tokenizers import Tokenizer

from twinbill.llm.bpe import decode, digests, encode


def _expected(path, texts):
    library = Tokenizer.from_file(path)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [library.decode(i, skip_special_tokens=False) for i in ids]


def _check(spark, path, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decode(encode(df, path), path).collect()}
    ids, decoded = _expected(path, texts)
    for k in range(len(texts)):
        assert got[k].ids == ids[k], texts[k]
        assert got[k].text == decoded[k]


def test_random_strings(spark, bpe_path):
    rng = random.Random(11)
    pieces = ["a", "b", "'", "s", "'re", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "!", "...", "<|endoftext|>",
              "<|endof", "中文", "🙂", "E", "the ", "ing", "aaaa", "　", " "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)]
    _check(spark, bpe_path, [*texts, None, ""])


def test_long_runs_and_ties(spark, bpe_path):
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 90))) for _ in range(500)]
    _check(spark, bpe_path, [*texts, "a" * 5000, "ab" * 3000, " " * 1000, "\n" * 999 + "x", "=-" * 777])


def test_every_code_point(spark, bpe_path):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    _check(spark, bpe_path, ["".join("a" + c + "1" + c + " " + c for c in points[k : k + 2000]) for k in range(0, len(points), 8000)])


def test_table_digests(spark, docs, bpe_path):
    rows = docs.select("doc_id", "text").collect()
    ids, _ = _expected(bpe_path, [r.text for r in rows])
    got = {r.doc_id: r for r in digests(docs, bpe_path).collect()}
    assert len(got) == len(rows)
    for row, own in zip(rows, ids, strict=True):
        r = got[row.doc_id]
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, bpe_path):
    rows = odd_docs.collect()
    out = decode(encode(odd_docs, bpe_path), bpe_path).collect()
    assert sorted((r.doc_id or -1, r.text) for r in out) == sorted((r.doc_id or -1, r.text or "") for r in rows)
    assert digests(no_docs, bpe_path).count() == 0


def test_null_ids_decode_to_nothing(spark, bpe_path):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in decode(df, bpe_path).collect()] == ["", ""]
