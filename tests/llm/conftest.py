import hashlib
import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, path string, bucket int, row string"


def corpus():
    """Small documents with copies, near copies, a common passage, personal data, odd and empty texts, nulls and repeats."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [say(rng.randint(20, 120)) for _ in range(40)]
    texts += texts[:6] + [t.replace(t.split()[5], "Changed", 1) for t in texts[6:14]] + [f"{say(15)} {passage} {say(15)}" for _ in range(8)]
    texts += ["", " ", "a", "one two  three", "Ünïcode ß 日本 🙂\n\nx\t y ", "ab" * 400, "=" * 300, say(4000), "mail bob.x+1@mail.example.com or 10.0.0.256 and 10.0.0.1, card 4111 1111 1111 1111 call +1 (555) 123-4567", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5, "another text under a known id " + say(30)), (None, texts[2]), (None, None)]
    return [(i, t, "en", rng.choice(["a", "b", "c", None]), None, "p", 1, "r") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
