from __future__ import annotations

import pytest

from tests.conftest import DATA

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "


def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    base = LONG * 4
    return [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base + "more", "en", "a", 2),
        (2, "another text under the same id", "de", None, None),
        (None, base, None, "b", 3),
        (None, None, None, None, None),
        (3, None, "en", "a", None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", None, "b", 4),
        (6, "word", "fr", "c", 4),
        (7, "The <|endoftext|> SAME the same 日本語 é 🙂\n\nthe same the same the same", "fr", "c", 9),
        (8, (LONG * 3000).replace("mu nu", "mu x nu"), "en", "a", 7),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "predicted", "size", "taken", "target", "component", "row_hash", "node", "n_tokens", "kept", "quality", "length")


@pytest.fixture
def edge(spark):
    """The edge rows, with columns whose names operators use themselves."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name.upper()}")
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")
