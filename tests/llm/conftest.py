import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use inside or give back.
EXTRA = """size kept component_id text_hash h slot rep group n a b score l k w t s x r p pred lang_pred runs run_id run_hash copy copies whole under of_source
gone source_size target taken ids seed url html kinds starts ends licenses part m pos h1 h2 n_lines keep_bitmap next_id head to_id want fingerprint all
__lang_pred __lang_score __n_lines __n_dropped __whole __id __h __runs __mix_id __copies __copy __gone __now""".split()


@pytest.fixture
def docs(spark):
    def make(texts, ids=None, sources=None, langs=None, extra=False):
        n = len(texts)
        rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s"] * n, [len(t or "") for t in texts], strict=True))
        frame = spark.createDataFrame(rows, SCHEMA)
        return frame.withColumns({c: F.lit("x") for c in EXTRA}) if extra else frame

    return make


@pytest.fixture(scope="session")
def sample(spark):
    from tests.conftest import SMALL

    return spark.read.parquet(f"{SMALL}/documents.parquet")


#: Texts that every operator must take: null, empty, blank, one word, odd characters, repeated rows, one very long text.
ODD = [None, "", "  \n\t ", "one", "é☃\U0001f600▁ <s>", "same words here again and again", "same words here again and again", "\n\n", "word " * 40000]
