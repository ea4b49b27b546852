import pytest

#: Rows (doc_id, text, lang, source) with nulls, empty and long texts, ties and repeated rows.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "one two three", "en", "a"),
    (3, "one two three", "en", "a"),
    (None, "one two three", None, "b"),
    (None, None, "de", "b"),
    (4, "   \n\t ", "de", None),
    (5, "\U0001f600 é ß \\ '\" $1 {x} % _", "fr", "é"),
    (6, "long " * 30_000, "en", "a"),
    (7, "x" * 60_000, "en", "c"),
    (8, "One Two THREE", "en", "b"),
    (9, "joe@x" + ".ab" * 33_000, "en", "b"),
    (10, "-----BEGIN " + "A " * 50_000 + "x PRIVATE KEY-----", "en", "b"),
    (11, "7" * 100_000, "de", "b"),
    (12, "a" * 64_000 + "@b.cd", "de", "c"),
    (13, "([{<" * 25_000, "de", "c"),
    (14, "eyJ" * 33_000, "fr", "c"),
    (15, "@" * 100_000, "fr", "a"),
    (16, "+1 (" * 25_000, "fr", "a"),
    (17, "password=" * 11_000, "fr", "a"),
    (18, "1.2.3." * 16_000, "fr", "a"),
]
#: Extra columns named like the columns operators use or return.
CLASHES = "_id string, _text string, _h int, _k1 int, _row string, kept boolean, score double, size int, comp int, n_hit int, set int"


@pytest.fixture
def odd(spark):
    """The rows above with extra columns of clashing names."""
    base = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    extra = [c.split() for c in CLASHES.split(", ")]
    return base.selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in extra])


@pytest.fixture
def empty(odd):
    return odd.where("false")


def same_columns(a, b):
    return a.schema.fieldNames() == b.schema.fieldNames()
