import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, row long, key string, size string, ledger int, fingerprint string, gone int"


def rows():
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, near and exact copies, passages."""
    rnd = random.Random(7)
    vocab = ["w%d" % i for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    lines = lambda k, n: "\n".join(prose(n) for _ in range(k))
    passage, body = prose(80), lines(6, 30)
    near = body.replace("w", "v", 1)
    out = [(None, None, None), (None, "", "b"), (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (4, "one", "a"), (5, "one", "a"),
           (6, body, "a"), (7, body, "b"), (7, body, "b"), (8, near, "a"), (9, prose(20) + " " + passage + "\n" + prose(20), "a"),
           (10, prose(10) + " " + passage[:300] + "\n\n" + prose(5) + "\n" + passage, "c"), (11, lines(3, 12) + "\n" + "A B\nA B\n", None),
           (12, prose(15000), "a"), (13, "x" * 50_000 + " 1" * 300, "c"), (14, "É ß ﬁ İ \u00a0 \u2003 中文 😀 " * 9, "a"), (15, "a b c " * 40, "d")]
    line = prose(14)
    words = line.split()
    edits = [line, " ".join(words[:5] + ["new"] + words[6:]), " ".join(words[:3] + words[4:]), " ".join([*words, "more"]), "  " + line + " \t",
             " ".join(words[:2] + ["two", "new"] + words[4:])]
    out += [(20 + i, prose(12) + "\n" + e, "a") for i, e in enumerate(edits)]
    out += [(100 + i, body if i % 2 else near, "hot") for i in range(40)]
    return out


@pytest.fixture(scope="session")
def messy():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, messy):
    """The rows with further columns, some of them null or named like inner ones."""
    return spark.createDataFrame([(i, t, s, None, None, 1, "k", "z", 3, None, 0) for i, t, s in messy], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id = -1")


def unique(messy):
    """{doc_id: text} of the rows with an id, which repeat only as whole rows."""
    return {i: t for i, t, _ in messy if i is not None}
