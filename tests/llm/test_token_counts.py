import public_tokenizers
import regex

from twinbill.llm.token_counts import Unigram, token_counts


def _compare(df, bpe_path):
    model, pattern = Unigram(bpe_path), regex.compile(public_tokenizers.PATTERN)
    known, expected = {}, []
    for r in df.select("doc_id", "text").collect():
        words = pattern.findall(r.text or "")
        for w in words:
            if w not in known:
                known[w] = model.one(w.encode())
        size = len((r.text or "").encode())
        expected.append((r.doc_id or -1, len(words), sum(known[w][0] for w in words), size, sum(known[w][1] for w in words)))
    out = token_counts(df, bpe_path).collect()
    got = [(r.doc_id or -1, r.n_pretokens, r.n_tokens, r.n_bytes, round(-r.log_prob * 1e6)) for r in out]
    assert sorted(got) == sorted(expected)


def test_table_against_dynamic_programming_per_word(docs, bpe_path):
    _compare(docs, bpe_path)


def test_long_words_and_odd_rows(spark, odd_docs, no_docs, bpe_path):
    _compare(odd_docs, bpe_path)
    rows = [(1, "a" * 3000), (2, "ab" * 200), (3, "=-" * 130), (4, "\u00e9" * 300), (5, " " * 500)]
    _compare(spark.createDataFrame(rows, "doc_id long, text string"), bpe_path)
    assert token_counts(no_docs, bpe_path).count() == 0


def test_best_segmentation_is_the_cheapest(bpe_path):
    model = Unigram(bpe_path)

    def all_costs(word):
        if not word:
            yield 0, 0
        for k in range(1, len(word) + 1):
            if word[:k] in model.cost:
                for cost, count in all_costs(word[k:]):
                    yield cost + model.cost[word[:k]], count + 1

    for word in (b" the", b"thing", b"zzq", b"unhappy", "né".encode()):
        assert model.one(word) == min(all_costs(word))[::-1]
