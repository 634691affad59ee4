import pytest


@pytest.fixture
def docs(spark):
    """Small texts with nulls, empty and odd ones, repeated rows, and further columns with clashing names."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    passage = "shared " * 5 + " ".join(f"word{k}" for k in range(60))
    odd = [None, "", "   ", "a b c", "  a  b \n\n c<|endoftext|> x  ", "<s> <|startoftext|>FOO ̈ \n", "x\x1fy   　z\n", passage + " one", passage + " two", "ab" * 300, "é" * 300]
    rows = [(10**6 + i, t, None, None, None) for i, t in enumerate(odd)] + [(None, "no id", "en", "s", 5)]
    out = base.unionByName(spark.createDataFrame(rows, base.schema))
    return out.selectExpr("*", "1 as score", "2 as n", "'x' as sig", "3 as bucket", "4 as ids")
