import pytest
from pyspark.sql import SparkSession


@pytest.fixture
def documents(spark: SparkSession):
    """Makes (doc_id, text, lang, source, n_chars) from (id, text) pairs."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long",
        ).repartition(3)

    return make
