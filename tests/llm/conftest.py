import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, u string, _k int"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every awkward case: nulls, empties, repeats, shared passages, extra columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    texts = [text(rng.randint(1, 120)) for _ in range(30)]
    texts += [None, "", " \n\t ", "one", "one two", "日本語 テキスト " * 9, "a" * 450, "ab" * 300, texts[0], texts[1], texts[0]]
    texts += [text(20) + " " + passage + " " + text(15), passage, text(3) + " " + passage[:150], texts[4] + " end", texts[5].replace("a", "A"), "\n\nx \n y\t z  w ", text(4000)]
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", None, None, None, None, None), (3, texts[3], "en", "s", 1, 7, "x", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
