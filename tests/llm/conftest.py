import pytest


@pytest.fixture
def table(spark):
    """A DataFrame of rows with a schema, in several partitions."""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture
def documents(table):
    """Documents with columns whose names operators use as well."""

    def make(rows):
        return table("doc_id long, text string, lang string, source string, n_chars long, kept string, key string, label int",
                     [(i, t, "en", s, len(t or ""), "x", None, 1) for i, t, s in rows])

    return make
