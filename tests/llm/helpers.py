"""Fixtures shared by the tests of the training-data operators."""

import pandas as pd
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows, parts=3):
    """rows: (doc_id, text); parts: partitions, so that several tasks see them."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.repartition(parts) if rows else df


def clashing(df):
    """The same with columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    names = ["TEXT", "Doc_ID", "ids", "tie", "start", "pos", "key", "n_words", "score", "word", "h", "w", "block", "template", "class_id"]
    spare = df.select("*", *[F.lit(f"x{i}").alias(f"z{i}") for i in range(len(names))])
    return spare.toDF(*df.columns, *names)


def rows(df) -> pd.DataFrame:
    return df.toPandas()
