import pytest

# names that operators might use inside; they must not get in each other's way
CLASH = "node key row batch lang_pred score text_hash first class_id block blocks size cell far query part turn length sequence_id offset name words number numbers tokens weight copies passes host path rule digest short full expression bytes revisit file html2 vec id norm train word order".split()


def document_rows():
    base = " ".join(f"word{i % 97}x{i}" for i in range(120))
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # a copy
        (2, base, "en", "a"),  # the same row again
        (3, base.replace("word5x5 ", "other "), "en", "b"),  # a near copy
        (4, None, "en", None),
        (5, "", "en", "b"),
        (6, " \n\t\n ", None, "b"),
        (7, "12 34 !?", "de", "b"),
        (None, "the end of the line", None, "c"),
        (None, "the end of the line", "en", "c"),
        (8, "der die das und nicht ein\nder die das und nicht ein\n\nThe End of the LINE", "de", "c"),
        (9, "Ångström résumé 東京 привет мир", "sv", "d"),
        (10, "a " * 30_000, "en", "d"),
        (11, "y" * 200_000, "en", "d"),
        (12, "one two", "en", "e"),
        (13, "ONE two", "de", "e"),
        (14, "<|endoftext|> one <|endoftext|>", "en", "e"),
    ]


@pytest.fixture(scope="session")
def odd_documents(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in document_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(None if i % 2 else 1).cast("int").alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
