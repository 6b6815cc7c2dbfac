import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """rows: (doc_id, text) pairs; extra: more columns, all null."""
    data = [(i, t, "en", "src1", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    for c in extra.split():
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Null, empty and white texts, a null id, repeated rows and ids, a very long text, odd white space."""
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000, 50_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "one two"), (6, "one two three\u0085four"), (7, long), (8, long), (9, "x" * 300_000), (None, "no id at all here now"), (10, "ONE Two")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
