from datetime import datetime, timedelta

from helpers import got

from recollect.operators import facts
from recollect.streaming import facts as streamed

SCHEMA = "id bigint, subject string, attribute string, value string, valid_from timestamp_ntz"


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()


def test_streamed_filing_matches_the_table(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [(k, "u" if k % 2 else "v", "a", "xyz"[(k * 5) % 3], day((k * 7) % 11)) for k in range(30)]
    path = str(tmp_path / "in")
    for part in (rows[:9], rows[9:20], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    run(streamed.filed(stream), "filed_facts")
    assert got(spark.table("filed_facts"), "id", "value") == got(facts.filed(spark.createDataFrame(rows, SCHEMA)), "id", "value")


def test_streamed_turns_are_taken_once(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id string, arrived timestamp, text string"
    for part in ([("a", "x"), ("b", " ")], [("a", "x"), ("c", "y")]):
        spark.createDataFrame([(i, datetime(2024, 1, 1), t) for i, t in part], schema).coalesce(1).write.mode("append").parquet(path)
    run(streamed.stored_turns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), "stored_turns")
    assert got(spark.table("stored_turns"), "id") == [("a",), ("c",)]
