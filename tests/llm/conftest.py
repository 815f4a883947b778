import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tieout.llm.common import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with further columns, among them names that the operators use inside."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F
        return df.withColumn("key", F.lit("x")).withColumn("n", F.lit(1)).withColumn("spans", F.lit("y")).withColumn("Row", F.lit(2))
    return make
