import public_tokenizers
import pytest

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a repeated row, a repeated id, a long text, clashing extra columns."""
    long = "word " * 60_000
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven eight nine ten."),
        (4, "One two three four five six seven eight nine ten."), (5, "Élan, naïve “quoted” 中文 🙂"),
        (None, "One two three four five six seven eight nine ten."), (None, None), (6, long), (7, long), (5, "other text"),
    ]
    names = "band u v id rep digest cut keep row block special fold gone_id bad_id items sketch n x".split()
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, *[9] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
