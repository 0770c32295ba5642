import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHING = "fp long, root long, tile long, guest boolean, words string, row long, lines string, found string, start long, length long, key long, sig long, at long, kind string, part int, nth long, rank long, component_id long, label string, token string, line string, block string, _gone long, _id long, _hit long, _found string, held_out string, score double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None if text is None else len(text)) + (None,) * (len(SCHEMA.split(",")) - 5)


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table with clashing columns from (doc_id, text[, lang]) rows."""
    return lambda rows, parts=3: spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, repeats inside a text, ties and repeated rows."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "dé", "the", "of", "im", "straße", "x", "12", "Licensed", "under", "CC", "BY", "4.0."]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, long = prose(70), prose(9000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ???"), (5, "word"), (6, shared), (7, shared), (8, prose(30) + "\n" + shared + " " + prose(25)), (9, long), (10, long[:20000] + prose(3)), (11, "ab " * 400), (12, "a" * 1500)]
    rows += [(20 + i, prose(rng.randint(1, 120))) for i in range(25)]
    rows += [(6, shared), (None, shared), (None, "lonely words without an id"), (60, "Ünïcödé 😀 " * 30), (61, "All rights reserved.\nReleased under the MIT License."), (62, "\x00\x01 nul \x0b tab"), (13, shared)]
    return rows
