import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, component_id string, held_out string, block string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, repeated lines, nulls, empty and long ones; ids may be null or repeat."""
    rng = random.Random(5)
    out = []
    for k in range(40):
        out.append(words(rng, rng.choice([1, 2, 5, 40, 120])))
    base = words(rng, 200).split(" ")
    for k in range(12):
        changed = list(base)
        for _ in range(k):
            changed[rng.randrange(len(changed))] = "zz" + str(rng.randrange(1000))
        out.append(" ".join(changed))
    out += [out[3], out[3].replace(" ", "\t \n"), out[3].upper(), "", None, " ", "\n\t", None, "word", "WORD", words(rng, 20_000), "same line\n" * 30, "éàü ß 漢字 😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "hot" if i % 2 else ["a", None][i % 4 // 2], len(t or ""), "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
