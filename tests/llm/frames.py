"""Small tables with the cases that every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, digest string, sketch int, found string, copy_no int, spans string"

LONG = "word and another " * 20_000


def edge_rows():
    base = [
        (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t", None, "a"), (4, "same text of some words here", "en", "b"),
        (5, "same text of some words here", "en", "a"), (5, "same text of some words here", "en", "a"), (6, LONG, "en", "a"),
        (7, LONG, "en", None), (None, "a row without an id, but with words", "en", "a"), (8, "!!! 123 ...", None, None),
        (9, "Ünïcödé ﬁne 日本語 🙂 text", "de", "c"), (10, "x", "de", ""), (11, "same  text of some words here", "en", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "h", "d", 1, "f", 2, "s") for r in base]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")


def columns(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]
