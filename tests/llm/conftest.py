import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None), (2, ""), (3, "one"), (4, "one two three four five"), (4, "one two three four five"),
    (None, "no id here but words"), (5, "tab\tand\x0bvt\x0cff\rcr\nline\n\nline\nlast"),
    (6, "𝔘nicode é ß 漢字 " * 40), (7, "same words again " * 80), (8, "x" * 5000), (9, "a b c d e f g h i j " * 600),
    (10, " \t\n "), (11, "MANY LOUD WORDS!! " * 30), (12, "tab | le | rows | of | junk | " * 20), (13, "<|im_start|> <\\|x # $ % & > *"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def write(spark, tmp_path, **tables):
    """A data folder with the given tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
