import pandas as pd
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    words = "river stone maple quiet window garden copper lantern meadow thunder velvet harbor pencil orchid summit ember".split()
    return " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] + str((seed * 31 + i) % 97) for i in range(n))


@pytest.fixture
def make(spark):
    def build(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def odd(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = prose(3, 30_000)
    rows = [
        (1, prose(1, 60), "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "fr", "b", 4),
        (5, long, "en", "a", len(long)),
        (6, prose(1, 60), "en", "b", 10),
        (6, prose(1, 60), "en", "b", 10),
        (None, prose(9, 40), "en", "a", 1),
        (8, "Line one\nLine two\nline ONE  \n\u00e9\u00e8 \u4f60\u597d \U0001f600", "fr", "b", 3),
    ]
    return make(rows)


@pytest.fixture
def none(make):
    return make([])


def frame(df) -> pd.DataFrame:
    return df.toPandas()
