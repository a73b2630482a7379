import random

import pytest

WORDS = "the of sea tide moon harbour rope sail anchor wave storm keel mast gull shore north south deck oar bell lamp".split()


def _prose():
    rng = random.Random(17)

    def make(n):
        return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.8 else "") for _ in range(n))

    return make


@pytest.fixture
def prose():
    """Texts that don't depend on which tests ran before."""
    return _prose()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = _prose()(30_000)
    rows = [
        (1, "Alpha beta GAMMA delta", "en"), (2, "alpha BETA gamma delta", "fr"), (2, "alpha BETA gamma delta", "fr"), (3, None, None), (4, "", "en"), (None, "alpha beta gamma delta", "en"),
        (None, None, None), (5, long, "en"), (6, long + " end", "en"), (7, " \t\n ", "en"), (8, "É ALPHA é", "en"), (9, "é alpha é", "en"), (10, "x" * 200_000, "en"), (11, "one", "en"), (12, "one two", "en"),
        (21, "a harbour of its own", "en"), (21, "the north wind blows over another deck", "de"), (21, "A HARBOUR of its own", "en"), (21, "a harbour of its own", "en"),
    ]
    extra = "_label string, key string, fp string, n string, score string, place string, kind string, h string, sha string, grp string, kept string, text_key string, id string, path string, _gone_id string, _gone_key string, _gone_raw string, _same_text string, _stats_9 string, _again_id string, _again_key string, own_key string, windows string, content string"
    names = [x.split()[0] for x in extra.split(", ")]
    return spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, lang string, {extra}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
