import pytest

WORDS = "the shore was quiet and the lamps along the harbour went out one after another while nobody watched them go".split()
LONG = " ".join(WORDS[(7 * i) % len(WORDS)] + str(i % 97) for i in range(6000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, word string, row string, x string, score string"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), "s", "w", "r", "x", "k")


#: Nulls, empty and white-space texts, a very long one, ties, repeated rows, and columns whose names the operators use themselves.
AWKWARD = [
    row(1, " ".join(WORDS)), row(2, " ".join(WORDS)), row(3, ""), row(4, None), row(5, " \t\n"), row(6, LONG, "b"), row(6, LONG, "b"), row(7, LONG + " end", "b"),
    row(None, "nobody numbered this document of words", None), row(None, None, None), row(8, "one"), row(9, "É ünïcode 日本語 😀 text | a.b", None), row(10, "x" * 3000, "c"), row(11, "Don't STOP <|endoftext|> now", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


class Components:
    """Union-find for brute-force comparisons."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
