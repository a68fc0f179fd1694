"""Small tables for the operators: nulls, empty and very long texts, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = "the river ran past the old mill and nobody in the village could remember a summer as dry as this one had been so far"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))


def documents(spark, rows):
    """Rows of (doc_id, text) as a documents table."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)


def edge_rows():
    """Ids and texts of the usual odd cases."""
    return [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, PROSE), (5, PROSE), (6, LONG), (7, "x"), (None, PROSE), (8, "naïve 漢字 \U0001f600 ЖЗИ 123"), (9, "!!! ???")]


def crowded(docs):
    """The same table with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "component_id", "spans", "item_ids", "score", "predicted", "h1", "line_no", "line", "entities", "line_classes", "first", "n_words", "ids", "start", "label", "rank", "key", "weight", "raws", "_of", "count", "cell"]
    return docs.select("*", *[F.lit("extra").alias(n) for n in names])
