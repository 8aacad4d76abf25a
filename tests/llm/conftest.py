import os

import pytest

SF_DIR = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
PASSAGE = " ".join(f"Passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("shared tables are not here")
    return SF_DIR


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """The smallest documents table as a list of rows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are easy to get wrong, with extra columns named like the operators' own."""
    near = PASSAGE.replace("Passage59", "Other")
    values = [
        (10, PASSAGE), (11, PASSAGE), (12, near), (None, PASSAGE), (None, None), (13, None), (14, ""), (15, " \n\t "),
        (16, "one"), (17, LONG), (18, LONG + " end"), (19, "two words"), (19, "two words"), (19, "other words here"),
        (20, "ünï çødé 日本語 🙂 ▁ mark  double"), (21, "\x00 nul \x0b tab\x0c feed\r\n line"),
    ]
    schema = "doc_id long, text string, _key int, _text int, _id int, ids int, spans int, fp int, score int, n_words int"
    return spark.createDataFrame([(*v, 1, 2, 3, 4, 5, 6, 7, 8) for v in values], schema)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
