import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture
def clash():
    """Adds columns whose names operators use inside."""

    def add(df, names=("key", "digest", "size", "score", "cell", "rep", "payload", "target", "band", "rank", "_source", "h", "label")):
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(f"own {n}"))
        return df

    return add
