import datetime as dt

from saleslens import schemas as S
from saleslens.streaming.contacts import apply_status_stream, contact_counts, count_contacts, counted

T = dt.datetime


def test_status_stream_may_be_run_again(spark, tmp_path):
    clients = spark.createDataFrame([(1, "pending", None), (2, "pending", None)], "id long, status string, last_contact_date timestamp")
    incoming = f"{tmp_path}/in"
    spark.createDataFrame([(1, "contacted", T(2024, 1, 1)), (9, "lost", T(2024, 1, 1))], S.STATUS_CHANGES).write.parquet(incoming)

    def before(batch):
        return clients if batch == 0 else spark.read.parquet(f"{tmp_path}/out/clients/batch={batch - 1}")

    def run():
        changes = spark.readStream.schema(S.STATUS_CHANGES).parquet(incoming)
        apply_status_stream(changes, before, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()

    run()
    spark.createDataFrame([(2, "lost", T(2024, 1, 2))], S.STATUS_CHANGES).write.mode("append").parquet(incoming)
    run()
    run()
    last = {r["id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out/clients/batch=1").collect()}
    assert last == {1: "contacted", 2: "lost"}
    assert spark.read.parquet(f"{tmp_path}/out/contacts").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1


def test_late_contacts_are_left_out(spark, tmp_path):
    schema = "id long, client_id long, contacted_at timestamp, outcome string"
    incoming = f"{tmp_path}/in"
    first = [(1, 1, T(2024, 1, 1, 9), "success"), (2, 1, T(2024, 1, 1, 10), "martian"), (3, 1, T(2024, 1, 9, 10), None)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(incoming)
    counts = contact_counts(spark.readStream.schema(schema).parquet(incoming), "2 days")
    query = counts.writeStream.format("memory").queryName("late_contacts").outputMode("append").option(
        "checkpointLocation", f"{tmp_path}/log").start()
    query.processAllAvailable()
    spark.createDataFrame([(4, 1, T(2024, 1, 1, 11), "success")], schema).coalesce(1).write.mode("append").parquet(incoming)
    query.processAllAvailable()
    query.stop()
    got = {(str(r["date"]), r["outcome"]): r["n"] for r in spark.table("late_contacts").collect()}
    assert got == {("2024-01-01", "success"): 1, ("2024-01-01", "other"): 1}


def test_late_contacts_are_counted(spark, tmp_path):
    schema = "id long, client_id long, contacted_at timestamp, outcome string"
    incoming = f"{tmp_path}/in"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(incoming)
        count_contacts(spark.readStream.schema(schema).parquet(incoming), f"{tmp_path}/out", f"{tmp_path}/log", "2 days").awaitTermination()

    run([(1, 1, T(2024, 1, 9), "success"), (2, 1, T(2024, 1, 1), "martian"), (3, 1, None, "success")])
    run([(4, 1, T(2024, 1, 1, 5), "success"), (5, 1, T(2024, 1, 8), "success"), (6, 1, None, "success")])
    run([(7, 1, T(2024, 1, 6), "success")])
    got = {(str(r["date"]), r["outcome"], r["late"]): r["n"] for r in counted(spark, f"{tmp_path}/out").collect()}
    assert got == {("2024-01-09", "success", False): 1, ("2024-01-01", "other", False): 1, ("None", "success", False): 2,
                   ("2024-01-01", "success", True): 1, ("2024-01-08", "success", False): 1, ("2024-01-06", "success", True): 1}
