DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, parts=3):
    """rows: (doc_id, text) with the other columns filled, and columns whose names an operator may use itself."""
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(parts)
    return frame.selectExpr("*", "1 AS size", "'x' AS score", "2 AS component_id", "3 AS text_key", "'y' AS th")
