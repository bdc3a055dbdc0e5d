"""Small document tables with the awkward rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_table(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = list(zip(ids or range(n), texts, langs or ["en"] * n, sources or ["a"] * n, [len(t or "") for t in texts]))
    return spark.createDataFrame(rows, DOCS)


AWKWARD = ["One two three.", None, "", " \n\t ", "x" * 5000, "word " * 3000, "One two three.", "é ü ß 漢字 😀", "a\x00b c",
           "!!! ??? 123"]


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
