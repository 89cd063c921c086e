import pytest

from quillmill.plans import catalogue

from .harness import compare

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) > 0


def test_dropped_questions(spark):
    from quillmill.operators.rows import dropped_questions

    turns = [(1, 0, "assistant", "One. Is it? Yes! Why؟"), (1, 1, "user", "q?"), (1, 2, "assistant", "new?"), (1, 3, "assistant", None), (2, 0, "assistant", "only?")]
    got = dropped_questions(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.turn, r.question) for r in got) == [(1, 0, "Is it?"), (1, 0, "Why؟")]


def test_top_k_in_blocks_and_empty(spark):
    from quillmill.operators.retrieval import top_k

    rows = [(i, [float(i % 5), 1.0, float(i)], i % 2, None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, domain int, source_file_id string")
    queries = chunks.selectExpr("chunk_id AS query_id", "vector", "domain").where("query_id < 10")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id) for r in df.collect())
    assert key(top_k(queries, chunks, 3)) == key(top_k(queries, chunks, 3, max_queries=3))
    assert top_k(queries.limit(0), chunks, 3).count() == 0 and top_k(queries, chunks.limit(0), 3).count() == 0


def test_rate_windows_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmill.streaming.progress import rate_windows

    lines = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("component"), "ts")
    lines.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    run = rate_windows(stream).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("rates")) == key(rate_windows(lines))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
