import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 8000

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A maker of documents from texts, with columns whose names clash with those of results."""

    def make(*texts, lang="en", source="s", extra=False):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            df = df.selectExpr("*", "7 as score", "'x' as lang_pred", "'y' as spans", "1 as size", "2 as id", "3 as held_out", "4 as class_id", "'z' as digest")
        return df

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
