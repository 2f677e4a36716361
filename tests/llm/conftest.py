import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tk long, comp string, node long"
WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "", "ing", "ed", "er"])
        out.append(w)
        if i % 11 == 10:
            out[-1] += rng.choice([".\n", ". ", ", "])
    return " ".join(out)


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose with exact and near copies, shared passages, odd texts, and columns whose names clash."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(5, 200)) for _ in range(n)]
    passage = prose(rng, 60).replace("\n", " ")
    line = "This very same line stands in a lot of documents."
    for i in range(0, n, 7):
        texts[i] = f"{texts[i]}\n{line}\n{passage}"
    for i in range(3, n, 9):
        words = texts[i - 1].split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts[5] = texts[40] = texts[4]
    texts[10:16] = [None, "", " \t\n\x0b ", "x", "Same Same Same " * 40, "a\r\nb  c\td " + "é" * 30 + "\n" + "É" * 30]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", None]), None if t is None else len(t), 7, "x", 1) for i, t in enumerate(texts)]
    out.append(out[20])  # a repeated row
    out.append((21, "another text of a doc_id that is there", "en", "src0", 1, 7, "x", 1))
    out.append((None, texts[4], None, None, 0, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    df.cache()
    return df


@pytest.fixture(scope="session")
def unique_docs(spark):
    """Each doc_id once and never null: for comparison with plain Python."""
    data = [r for r in rows()[:60]]
    return spark.createDataFrame(data, SCHEMA).cache(), [(r[0], r[1]) for r in data]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
