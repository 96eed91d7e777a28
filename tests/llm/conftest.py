import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Names that the operators use inside; a document table may have them too.
CLASHING = ["score", "spans", "kept", "ids", "fp", "d", "k1", "k2", "row", "h", "list", "group", "component", "label", "n", "start", "end", "url2"]


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, texts without letters, columns with clashing names."""
    english = "the quick brown fox and the lazy dog were in the house of the old man that was by the river "
    french = "le chat et le chien sont dans la maison de la vieille dame qui est pres de la riviere avec une amie "
    rows = [
        (1, english * 4, "en", "a", 1),
        (2, french * 4, "fr", "a", 1),
        (3, english * 4, "en", None, None),
        (3, english * 4, "en", None, None),
        (None, french, None, "b", 5),
        (None, None, None, None, None),
        (4, None, "en", "a", 0),
        (5, "", "fr", "a", 0),
        (6, " \n\t ", None, "a", 3),
        (7, "12 34 !!! ###", "en", "a", 3),
        (8, "word " * 30000, "en", "a", 150000),
        (9, "x" * 20000, "en", "a", 20000),
        (10, "é日本語   \U0001f600 <|endoftext|> ça", "fr", "a", 9),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({name: F.lit(f"extra {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
