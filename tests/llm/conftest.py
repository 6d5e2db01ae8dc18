import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "Ünïc", "x", "zeta,", "eta."]


def texts(seed: int = 7) -> list:
    """Random texts with exact and near copies, shared passages, odd and empty ones."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))
    passage = say(25)
    out = [say(r.randint(1, 120)) for _ in range(40)]
    out += [out[3], out[5], out[3]]
    out += [f"{say(6)} {passage} {say(4)}" for _ in range(12)]
    out += [out[8].replace(" of", " off", 1), out[9] + "\nlast line", "\n".join([say(8), passage, say(5)])]
    out += [None, "", "   \n\t ", "one", "two words", "A" * 450, "ab " * 200, "\n\n\n", "tab\tand\x0bspace " * 20]
    return out


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame): repeated rows, null ids, extra columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(texts())]
    r = random.Random(1)
    r.shuffle(rows)
    rows += [rows[0], rows[1], (None, "null id " * 40), (None, rows[2][1]), (7, "another text under a used id " * 9)]
    wide = [(d, t, "clash", 0.5, b"x", 1) for d, t in rows]
    return rows, spark.createDataFrame(wide, "doc_id long, text string, score string, key double, tie binary, fp int").repartition(5)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus[1].limit(0)
