from pyspark.sql import functions as F

from ledgerloom.streaming import jobs


def test_a_stopped_stream_goes_on_after_its_last_file(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(src)
    run = lambda: jobs.run_to_end(jobs.expand_documents(jobs.read_files(spark, docs.schema, src)), out, mark)
    run()
    run()  # nothing new: nothing is written twice
    assert spark.read.parquet(out).count() == 2
    docs.withColumn("doc_id", F.col("doc_id") + 10).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 1, 11, 11]


def test_the_latest_result_replaces_the_one_before(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(src)
        jobs.keep_latest(jobs.read_files(spark, rows.schema, src).groupBy("k").count(), out, mark)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("a", 4), ("b", 2)}
