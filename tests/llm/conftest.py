import random

import pytest
from llm_words import prose

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, odd white space, extra columns with clashing names."""
    rng = random.Random(7)
    long_text = prose(rng, 30_000)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, long_text), (35, long_text + " more"), (None, prose(rng, 50)), (None, None)]
    rows += [(36, f"{prose(rng, 5)} {shared} {prose(rng, 9)}"), (37, f"{shared}\n\n{prose(rng, 40)}"), (38, shared), (38, shared), (38, shared + " other")]
    rows += [(39, "shti " * 200), (40, "a  b \x0b c\r\n<|endoftext|> d\x85e \x00 f"), (41, "Ünïcode 中文 “quotes” — dash" * 30)]
    return spark.createDataFrame(
        [(i, t, None, 5, None, None, 1, 2) for i, t in rows],
        "doc_id long, text string, lang string, n_chars long, fp string, row string, component long, `_row` int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
