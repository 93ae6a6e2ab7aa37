"""Small tables for the corpus operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    """Rows of (doc_id, text, lang, source), with the length filled in."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], schema)


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))
