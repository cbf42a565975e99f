import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (id, text) or (id, text, lang); with columns whose names the operators use themselves."""

    def build(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] else 0) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clash:
            for name in ("word", "words", "score", "shard", "slot", "fp", "node", "start", "end", "row", "n", "item_id", "_s", "doc", "at"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def sample():
    """Folder of the smallest driver tables."""
    return "/root/testdata/sf0.001"
