"""Small fixtures for the operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "plain words here, and  two   blanks\n\n \nlines "),
    (5, "plain words here, and  two   blanks\n\n \nlines "),
    (5, "plain words here, and  two   blanks\n\n \nlines "),
    (None, "no id at all 1234"),
    (7, "x" * 5000 + " é ñ ß 日本語    end\x1c\x85"),
    (8, "don't we'll  I'M <|endoftext|>tail <|startoftext|> 3.14 #*$%&|<>"),
    (9, "́ combining İ İstanbul ΟΔΥΣΣΕΥΣ Ωσ"),
]


def frame(spark, rows, extra=True):
    """Rows (doc_id, text) with further columns, some of which have names that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("n_words", "blob", "fingerprint", "component_id", "key", "start", "text_", "count"):
            df = df.withColumn(c, F.lit(1))
    return df
