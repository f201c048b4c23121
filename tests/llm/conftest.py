from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Columns called like what the operators use inside or return.
CLASHING = ("rid", "row_id", "digest", "component", "n_tokens", "kept", "h", "item_id", "spans", "threshold")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with clashing columns on request."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING]) if clash else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every place, empty and blank texts, repeats, and a very long text."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    long_text = " ".join(f"{w}{i}" for i in range(3000) for w in ("long", "text"))
    return [
        (1, words), (1, words), (2, words), (3, None), (4, ""), (5, " \n\t"), (None, words), (None, None), (None, words),
        (6, long_text), (7, long_text + " end"), (8, "one two"), (9, "one two"), (10, "12 34 !?"), (11, None, None), (12, words, None),
    ]
