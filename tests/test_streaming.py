from broadsheet.sources.fixtures import job_updates
from broadsheet.streaming import jobs
from tests.conftest import SF


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_latest_state_of_a_stream(spark, tmp_path):
    updates = job_updates(spark, SF)
    updates.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), updates.schema)
    got = run(jobs.latest(stream), "complete", tmp_path, "latest")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.latest(updates).collect()))


def test_windows(spark):
    w = jobs.windows(job_updates(spark, SF))
    assert w.agg({"n_events": "sum"}).first()[0] == job_updates(spark, SF).count()


def test_carry_over(spark, tmp_path):
    schema = "document_id long, page long, source_id long, target_page long"
    batches = [[(1, 1, 10, 3), (1, 2, 11, 9), (2, 1, 20, 1)], [(1, 3, None, None), (2, 4, 21, 7)]]
    source = tmp_path / "in"
    table = spark.createDataFrame(batches[0] + batches[1], schema)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = run(jobs.carry_over(stream), "update", tmp_path, "carried").collect()
    final = {}
    for r in got:
        if final.get((r.document_id, r.source_id)) != "RESOLVED":
            final[r.document_id, r.source_id] = r.status
    assert final == {(r.document_id, r.source_id): r.status for r in jobs.carried(table).collect()}
    assert final[1, 10] == "RESOLVED" and final[1, 11] == "PENDING_EXTERNAL" and final[2, 20] == "RESOLVED"
