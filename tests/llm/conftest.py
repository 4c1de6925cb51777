import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def documents(spark, tmp_path):
    """A stored table of documents from texts, or from (id, text) or (id, text, source)."""

    def make(rows, **extra):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, source = (*r, "s")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        for name, value in extra.items():
            df = df.selectExpr("*", f"{value} as {name}")
        path = str(tmp_path / f"docs{len(list(tmp_path.iterdir()))}")
        df.repartition(2, "doc_id").write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return make


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
