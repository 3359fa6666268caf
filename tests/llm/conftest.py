import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from broadsheet.session import local_session  # noqa: E402

# Names that operators use themselves, or might.
CLASHING = (
    "spans", "score", "rank", "text_key", "n_lines", "lang_pred", "_spans", "_gone", "_id", "_key", "_nth", "_text",
    "_text_key", "_lang_pred", "_score", "row", "gone", "rows", "nth", "id", "_of",
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, with a column whose name an operator might use."""
    def made(*rows):
        df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return made
