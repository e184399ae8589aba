import pytest

NASTY = [
    (1, "The cat sat on the mat. " * 30, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "b", 4), (5, "word " * 30000, "en", "a", 1), (6, "Licensed under the Apache License, Version 2.0.", "en", "b", 2),
    (6, "Licensed under the Apache License, Version 2.0.", "en", "b", 2), (6, "another text with the same id", "en", "b", 2),
    (None, "no id at all here", "de", None, 3), (8, "日本語 \u00e9\u0130 \U0001f600 #|$", "ja", "c", 1), (9, "you i d i o t, an id-iot", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "_key long, _text string, quality string, fingerprint string, Score double, copy int, _row long, _mark long, _source string, _u double, _table string, _ident string"


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(NASTY, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark, nasty):
    """The same rows with extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    for field in CLASHING.split(", "):
        name, kind = field.split()
        nasty = nasty.withColumn(name, F.lit(None).cast(kind))
    return nasty


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(None, None, None), (1, 1, None), (77, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
