"""Small tables with awkward rows that every operator has to take."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names some operator uses inside.
CLASHES = "size score held_out id th k w1 bucket hash fp component_id lang_pred languages media n_bytes ids decoded out n next_text copies mixed_id mixed_copy drop_id whole__ text__ starts__ n_lines n_removed label x word words band root".split()

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old fence near the river bank and nobody says anything about it for the rest of the day"
LINES = "first line here\nsecond line here\nthird line here\nfourth line here"


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(300_000))
    return [
        (1, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n ", "de", None, 4),
        (6, "12 34 !!", "fr", "b", 8),
        (None, "a text without an id but with words in it", "en", "b", 1),
        (None, None, None, None, None),
        (7, LINES, "en", "c", 1),
        (8, "intro\n" + LINES, "en", "c", 1),
        (9, PROSE, "en", "a", 10),
        (9, PROSE, "en", "a", 10),
        (10, "one", "fr", "a", 3),
        (11, "﻿naïve café 東京 😀   end", "fr", "d", 3),
        (12, long, "en", "d", len(long)),
        (13, "x" * 50_000, "en", "d", 50_000),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
