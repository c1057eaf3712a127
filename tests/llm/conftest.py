import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def run(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return run


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows; and columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    long = "word%d " * 20_000 % tuple(range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "!!! ???"), (6, long), (7, "one two three four five six seven eight nine ten"), (7, "one two three four five six seven eight nine ten"), (None, "a text without any id at all, is it"), (8, "one two three four five six seven eight nine ten", None), (9, "\n\n\nlast line of it\n"), (10, "ÄÖÜ ß ñandú 日本語 \U0001f600 end")]
    df = make(rows)
    clash = ["tokens", "word", "score", "whole", "line", "root", "position", "epoch", "block", "bin_id", "pairs", "rank", "quality", "toxic", "a", "b", "at", "n", "text2", "_llm_id", "_llm_gone", "_llm_flags", "_llm_times", "_llm_copy", "_LLM_bin", "contents", "flags", "key", "whole_", "row", "members", "low"]
    return df.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="session")
def none(make):
    return make([])
