import os

import pytest

D = "/root/testdata/sf0.001"
HAS_DATA = os.path.isdir(D)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, repeated and null ids, and columns whose names clash with inner ones."""
    rows = [(1, "The cat sat. " * 40, "en"), (1, "The cat sat. " * 40, "en"), (2, None, "en"), (3, "", None), (None, "###", "de"), (None, None, None), (4, "x " * 60_000, "en"), (5, "Der Hund läuft über die Straße und bellt laut", "de"), (6, "\n \t\n", "de")]
    cols = "doc_id long, text string, lang string, source string, n_chars long, score double, rep string, `size` long, key string, finish double, words string"
    return spark.createDataFrame([(i, t, lang, "s" if k % 2 else None, 0, 0.0, "r", 1, "k", 0.0, "w") for k, (i, t, lang) in enumerate(rows)], cols)
