import random
import re

import pytest

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORDS.findall(lowered(text))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with nulls, empties, copies, near copies, shared passages, a very long text and repeated rows."""
    rng = random.Random(3)
    base, passage = prose(rng, 300), prose(rng, 60)
    near = base.split()
    near[150] = "changed"
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, prose(rng, 40) + " " + passage + " " + prose(rng, 30), "en", "a"), (4, prose(rng, 20) + "\n" + passage.upper() + "! " + prose(rng, 10), "en", None)]
    rows += [(5, None, None, "a"), (6, "", "en", "b"), (7, " \n\t ", "en", "b"), (8, "One", "en", "b"), (9, "one", "en", "b"), (10, "é Ü ß", "fr", "b"), (11, prose(rng, 30_000), "en", "a"), (None, base, "en", "a"), (None, prose(rng, 80), None, None), (12, "tie", "en", "c"), (12, "tie", "en", "c")]
    rows += [(20 + i, prose(rng, 60 + i), "en", "a" if i % 3 else "d") for i in range(30)]
    rows += [(60 + i, " ".join(f"x{k if (k * 7 + i * 13) % 41 else i * 1000 + k}" for k in range(120)), "en", "a") for i in range(25)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return docs.where("false")
