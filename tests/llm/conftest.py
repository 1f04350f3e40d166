import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def docs(spark):
    from odspark.llm.staging import ship_package
    ship_package(spark)

    def make(texts, clash=False):
        rows = [(i, t, f"h{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        if clash:
            for c in ("n_words", "start", "kept", "component", "ids", "length", "_key", "line", "chunk", "n_tokens"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df
    return make


@pytest.fixture()
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
