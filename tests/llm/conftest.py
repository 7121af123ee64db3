import random

import pytest

SYLLABLES = ["the", "an", "der", "und", "que", "la", "sto", "rie", "mit", "ei", "ou", "ben", "tra"]


@pytest.fixture
def prose():
    """Reproducible invented prose: ``prose(words, seed)``."""
    def make(words, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(words))
    return make


@pytest.fixture
def frame(spark):
    """Documents with clashing extra columns: ``frame([(doc_id, text), ...])``."""
    def make(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long, sha string, kept int, component_id int, length int, name string"
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "s", 1, 2, 3, "n") for i, t in rows], kind)
    return make
