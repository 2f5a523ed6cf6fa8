import random

import pytest

#: Columns that the operators use inside; a user's table may have them too.
CLASH = "array() as spans, 'x' as d, 'y' as t, 'z' as h, 1 as fp, 'k' as key, 2 as row, true as kept, 'q' as __cut, 'w' as __keep, 0.5 as score, 'r' as rare"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank, one word, exact copies, repeated rows, near copies, shared
    passages, very long texts, and ids that are null or used twice."""
    random.seed(5)
    vocabulary = ["".join(random.choice("abcdeéßñ") for _ in range(random.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(random.choice(vocabulary) + random.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))

    passage, base, long = prose(90), prose(300), prose(9000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "Two words"), (6, "A b c"), (7, base), (8, base), (8, base),
            (9, base.replace("a", "A", 3)), (10, prose(50) + " " + passage + " " + prose(20)), (11, passage), (12, prose(120) + passage),
            (13, long), (14, long[5000:20000] + prose(100)), (15, "ab" * 1500), (16, "x" * 399), (17, "x" * 400), (None, prose(80)), (None, passage),
            (18, prose(60)), (18, prose(60)), (19, "a b c \x1c d"), (20, "\x00\x01 tail"), (21, None)]
    near = prose(400).split(" ")
    for k in range(12):
        copy = list(near)
        for _ in range(k % 4):
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, prose(random.randint(1, 200))) for k in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string").repartition(5)
    return df.selectExpr("doc_id", "text", *CLASH.split(", "))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
