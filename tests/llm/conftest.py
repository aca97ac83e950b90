import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, _key string"


def make_rows(n=120, seed=1):
    """Documents of invented words with copies, near copies, shared passages, nulls, empty and very long texts."""
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdeéiloñstu") for _ in range(r.randint(2, 9))) for _ in range(400)]

    def sentence():
        return " ".join(r.choice(stock) for _ in range(r.randint(3, 14))).capitalize() + "."

    passage = " ".join(sentence() for _ in range(8))
    texts = [" ".join(sentence() for _ in range(r.randint(2, 30))) for _ in range(n)]
    for k in range(0, n, 9):
        texts[k] = texts[k] + "\n" + passage + "\n" + sentence()
    texts[5] = texts[4]
    texts[6] = texts[4].replace(".", " !")
    ws = texts[10].split(" ")
    for k in (11, 12, 13):
        own = list(ws)
        own[r.randrange(len(own))] = "changed"
        texts[k] = " ".join(own)
    texts[20], texts[21], texts[22], texts[23] = None, "", " \n ", "one"
    texts[24] = " ".join(sentence() for _ in range(1500))
    texts[25] = "日本語の文章です。" * 5 + " <|endoftext|> naïve"
    rows = [(k, t, r.choice(["en", "fr"]), "s", len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    rows.append((None, "no id here at all. But words. And more of them in a row.", "en", "s", 9, "x", "y", "z"))
    rows.append(rows[30])
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
