import pytest

from odd_rows import DDL, ODD, SF


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "en", 1, 1, 2, "h", "l", "t", "s", "k", "h", 3, 4) for i, t, s in ODD], DDL)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
