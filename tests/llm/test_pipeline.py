import hashlib

import corpus_pipeline
from twinbill.llm.near_dup import near_duplicates
from twinbill.session import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, bpe_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "near duplicates", "decontamination", "token ids"
    ]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SMALL), name.replace(" ", "-")))
    for df in kept[1:-1]:
        assert df.columns == docs.columns and df.schema == docs.schema
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[4] == ids[5]
    # The near-duplicate stage leaves no links: run again, it finds none.
    assert near_duplicates(kept[3]).where("not kept").count() == 0
    library = Tokenizer.from_file(bpe_path)
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    for r in kept[5].collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, SMALL).count() == len(ids[5])


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, SMALL)
            some.collect()


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
