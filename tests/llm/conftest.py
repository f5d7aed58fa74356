import pytest

#: Texts that every operator has to bear.
ODD = [None, "", " ", "\n\t\n", "word", "a b", "déjà vu\r\nx", "日本語 テキスト", "🙂 " * 30, "a b", "  two  spaces  ", "x" * 5000, "the same line\n" * 50, "tie", "tie"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with nulls in every column, a repeated row, a very long text, and extra columns whose names clash."""
    rows = [(i, t, ["en", None, "xx"][i % 3], ["s1", None][i % 2], len(t or "")) for i, t in enumerate(ODD)]
    rows += [(None, None, None, None, None), (3, "again", "en", "s1", 5), (3, "again", "en", "s1", 5), (99, "long words here " * 60_000, "en", "s1", 960_000)]
    names = ("size", "shard", "findings", "measures", "label", "key", "block", "rows", "rid", "count", "id", "__id", "__mark", "__m", "__s", "__passes", "h_de", "s_en", "by_host", "posterior", "probability", "drawn", "rank", "first", "digest")
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
