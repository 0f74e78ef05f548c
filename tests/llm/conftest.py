import pytest

#: Documents that hold every awkward case: nulls, blanks, ties, repeated rows and ids, long texts, near copies.
BASE = " ".join(f"word{i}" for i in range(60))


def documents():
    near = BASE.replace("word30", "changed")
    far = " ".join(f"other{i}" for i in range(60))
    rows = [
        (1, BASE), (2, BASE), (2, BASE), (3, near), (4, far), (5, None), (6, ""), (7, "  \t\n "), (8, "two words"), (9, "Two WORDS"), (None, BASE), (None, None), (10, "é😀 ünïcode  text " * 30),
        (11, "x" * 30_000), (12, " ".join(str(i % 977) for i in range(40_000))), (13, far.upper()), (4, "same id, another text"), (14, "a<|endoftext|>b"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), "extra", 1) for i, t in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string, kept int"


@pytest.fixture(scope="session")
def docs(spark):
    """Extra columns clash with names the operators use inside."""
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
