import random

import pytest

#: Texts with every trap: null, empty, white space alone, ties, copies but for white space, very long.
TEXTS = [
    None, "", " \t\n", "a b c", "abc", "a\x0bbc", "a b  c", "A b c", "one two three four five six", "one two three four five six",
    "one two three four five seven", "x" * 5000, " ".join(["word"] * 3000), "é ü ñ 漢字 😀", "a b c", "line\nline\nother\nline\nline\nother\n", "\x1c\x1d\x85",
]


@pytest.fixture(scope="session")
def tricky(spark):
    """doc_id null and repeated, clashing column names, ties."""
    rows = [(i, t, "en", "src", 0, 1, 2, "h") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [(3, "a b c", "en", "src", 1, 1, 1, "h"), (None, "nobody's text", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, h string").repartition(3)


@pytest.fixture(scope="session")
def corpus(spark):
    """Random small texts over few words, so that copies and near copies abound."""
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [t + rng.choice(["", " ", " mu", "\n"]) for t in texts[:100]]
    long = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(400)) for _ in range(6)]
    texts += long + [t.replace("alpha", "omega", 1) for t in long]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
