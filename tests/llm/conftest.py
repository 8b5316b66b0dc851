import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = schema.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


#: Nulls, empty and blank texts, ties, repeated rows, long and odd texts.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "a b"), (6, "Shared line of some length\nown line number six\nShared line of some length"),
    (7, "  shared LINE of some length  \nshort\nown line number seven"), (8, "x" * 5000), (9, "word " * 3000), (None, "Shared line of some length"), (10, "é 🙂 日本語 <|im_end|> \\ \x0b\x1f\x85 end"),
    (11, "a  b   c \n\n d\t e"), (12, "tail space "), (13, "trailing\n line  "),
]


@pytest.fixture
def odd_docs(docs_of):
    return docs_of(ODD)


@pytest.fixture
def empty_docs(docs_of):
    return docs_of([])


@pytest.fixture
def clashing(odd_docs):
    """More columns, with the names that operators use themselves."""
    from pyspark.sql import functions as F

    return odd_docs.withColumns({x: F.lit("x") for x in ("fp", "id", "h1", "owner", "path", "k", "u", "v", "node", "component", "component_id", "kept", "n_words", "shard", "_gone", "family", "toxic", "items", "last", "refers_to", "part")})
