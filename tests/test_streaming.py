"""Incremental inventory: late and repeated rows, repeated batches."""

from tallyforge.streaming.incremental import InventoryTable, current_status, stream_inventory

SCHEMA = "place string, name string, file_type string, size bigint, sha1 string, got_status string, seen bigint"


def test_stream_keeps_the_last_row(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([("p", n, "File", 1, h, "Got", t) for n, h, t in x], SCHEMA)
    rows(("a", "x", 2), ("b", "y", 1)).write.mode("append").parquet(f"{tmp_path}/in")
    table = InventoryTable(spark, f"file://{tmp_path}/table")
    run = lambda: stream_inventory(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/check", ["place", "name"], "seen").awaitTermination()
    run()
    rows(("a", "old", 1), ("c", "z", 3), ("c", "z", 3)).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert {(r.name, r.sha1) for r in table.read().collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    catalog = spark.createDataFrame([("p", "a", "File", 1, "x", "InDatCollect"), ("p", "q", "File", 1, "x", "InDatCollect")], "place string, name string, file_type string, size bigint, sha1 string, dat_status string")
    assert {(r.name, r.got_status) for r in current_status(catalog, table, ["place"]).collect()} == {("a", "Got"), ("q", "NotGot"), ("b", "Got"), ("c", "Got")}
    table.write(table.read(1), 1, ["place", "name"], "seen")
