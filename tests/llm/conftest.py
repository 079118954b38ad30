import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """Small documents with copies, near copies, shared passages, nulls, empties, odd spaces, a long text, a hot source and clashing columns."""
    rng = random.Random(7)
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 13, 40, 150]))]
        if i % 7 == 0 and w:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(20) :]
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(w)))
    for i in range(120, 150):  # near copies of one base
        w = rows[6 * 7][1].split() or ["base"] * 40
        w = (w + [str(k) for k in range(200)])[:200]
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    for i in range(150, 170):  # exact copies
        rows.append((i, rows[130][1]))
    rows += [(170, None), (171, ""), (172, " \n"), (173, "É́é naïve ÀÉ — word"), (174, " ".join(rng.choice(words) for _ in range(6000))), (None, rows[130][1]), (130, rows[130][1]), (3, rows[3][1])]
    data = [(i, t, "src0" if n % 3 else "src1", n, -n, "x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_words long, g long, k string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
