import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, source) tuples, with extra columns of clashing names."""
    def make(rows):
        df = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1.5) for i, t, s in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long, "
                                   "size string, target double")
        return df
    return make


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
