import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema) with the rows spread over several partitions."""
    return lambda rows, schema, parts=3: spark.createDataFrame(rows, schema).repartition(parts)
