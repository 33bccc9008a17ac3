"""Small tables with the awkward cases every operator must take."""

EDGE = [
    (1, "Hello World. Hello World.", "en"),
    (2, "hello world. HELLO WORLD.", None),
    (3, None, "en"),
    (4, "", "en"),
    (5, "Ünïcödé ÉCOLE straße 漢字 \U0001f600 fin", "fr"),
    (6, "x" * 30_000, None),
    (7, "a b " * 8_000, "en"),
    (8, " \t\n\x0b\f\r ", "en"),
    (9, "Hello World. Hello World.", "en"),
]
SCHEMA = "doc_id long, text string, lang string"
#: Columns named like the operators' own results.
EXTRA = ["kept", "score", "n_words", "spans", "ids", "digest"]


def edge(spark, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in EXTRA}) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {d: t or "" for d, t, _ in EDGE}
