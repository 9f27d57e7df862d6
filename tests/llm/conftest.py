import pytest


@pytest.fixture
def frame(spark):
    """Rows of documents as a frame with an extra column that clashes with operators' own names."""
    from verba.runtime import prepare

    def make(rows, partitions=3):
        df = prepare(spark).createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.repartition(partitions)

    return make
