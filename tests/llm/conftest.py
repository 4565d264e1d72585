import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents-like frame from (doc_id, text) rows, with clashing extra columns."""
    def make(rows, extra=True):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        return d.selectExpr("*", "'x' AS w", "1 AS n", "'y' AS row", "2 AS bits", "0 AS sid") if extra else d
    return make
