import pytest

WORDS = "the of and to in thonst inlyer rethnd ça él straße 東京 naïve idiot".split()


def sentence(i, n):
    return " ".join(WORDS[(i * 7 + j * j + j // 3) % len(WORDS)] + ("" if j % 5 else str((i + j) % 9)) for j in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names the operators might use."""
    long = sentence(3, 20_000)
    rows = [(0, "The Same  text", "en", "a"), (1, "the same  TEXT", "en", "a"), (2, None, None, None), (3, "", "en", "b"),
            (4, "   ", "en", "b"), (5, long, "en", "a"), (6, long + "\tend", "de", "a"), (7, "Ärger A", "de", "a"), (8, "ärger a", "de", "a"),
            (9, "one line\n\n\nnext  ▁ line\x00  x\x1cy", "xx", "c"), (9, "one line\n\n\nnext  ▁ line\x00  x\x1cy", "xx", "c"),
            (10, "x" * 3000, "en", "c"), (None, "no id at all", "en", None), (11, "東京 👍🏽 ́combining", "ja", "c")]
    rows += [(100 + i, sentence(i, 5 + i * 3), "en", "a") for i in range(40)]
    rows += [(200 + i, "copied many times over", "en", "hot") for i in range(30)]
    full = [(*r, None if r[1] is None else len(r[1]), 1, "clash", 2.0, 7, None, "k") for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, slot int, digest string, n double, row long, uid long, key string"
    return spark.createDataFrame(full, names).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("1 = 0")
