"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku la le li lo lu".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n)).capitalize() + "."


def text(rng, words=120):
    out = []
    while words > 0:
        n = min(words, rng.randint(5, 15))
        out.append(sentence(rng, n))
        words -= n
    return "\n".join(out)


def documents(spark, rows, extra=""):
    """rows: texts, or (doc_id, text) pairs, or full rows."""
    made = []
    for i, r in enumerate(rows):
        r = (i, r) if not isinstance(r, tuple) else r
        made.append(r if len(r) > 2 else (*r, "en", f"s{i % 3}", len(r[1]) if r[1] is not None else None))
    return spark.createDataFrame(made, DOCS + extra)


def rng(seed=1):
    return random.Random(seed)


#: What every operator must live with: nulls in any column, empty and long texts, repeated rows and ids.
def awkward(spark):
    long_ = text(rng(3), 60_000)
    rows = [
        (None, "no id here, only words", "en", "a", 5),
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, "  \n\n ", "fr", "b", 4),
        (4, long_, "en", "a", len(long_)),
        (5, "same text of some words", "en", "a", 5),
        (5, "same text of some words", "en", "a", 5),
        (5, "another text under that id", "de", "b", 5),
        (6, "!!! ??? ...", "en", None, 3),
        (7, "é ü 漢字 \U0001f600", "xx", "c", 7),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    # names that operators might use themselves
    return df.selectExpr("*", "1 AS h", "2 AS keep", "'x' AS shard", "3 AS n", "4 AS th", "5 AS score", "6 AS probability", "7 AS line", "8 AS key", "9 AS v", "10 AS words")
