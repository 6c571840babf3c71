import pytest

from foliant.session import checkpoint_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    checkpoint_dir(spark)


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with an extra column of a clashing name."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)
        return df.withColumn("kept", F.lit(7)).withColumn("length", F.lit("x"))

    return make
