import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs everywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    run = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", "   \n", "one", "one two", run, run, run + " tail", "head " + run, "Ünï çødé ß 漢字 <|endoftext|> 12a's", "long " * 30_000, "idiot moron trash", "A\tB\x0bC D"]
    rows = [(i, t, "en", [None, "s1", "s2", ""][i % 4], None if t is None else len(t), 1, 2, "k") for i, t in enumerate(texts)]
    rows += [rows[5], (None, run, None, "s1", len(run), None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
