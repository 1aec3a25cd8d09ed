import datetime

from termloom.streaming import mentions

DAY = datetime.datetime(2025, 1, 1)


def test_stream_counts_equal_batch_counts_however_late(spark, tmp_path, table):
    rows = (
        [
            (i % 5, i % 3, ["s1", " S1", None][i % 3], DAY + datetime.timedelta(hours=7 * (i * 37 % 100)))
            for i in range(100)
        ]
        + [(1, 1, "s1", None)]
    )
    df = table("source int, target int, stratum string, seen_at timestamp_ntz", rows)
    for part in range(3):
        df.limit(30 * (part + 1)).subtract(df.limit(30 * part)).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "x.parquet")
        )
    stored = spark.read.parquet(str(tmp_path / "x.parquet"))
    got = {tuple(r) for r in mentions.stream_counts(spark, str(tmp_path / "x.parquet")).collect()}
    assert (
        got == {
            tuple(r)
            for r in mentions.daily_counts(stored).select("day", "stratum", "mentions", "self_mentions").collect()
        }
        and len(got) > 20
    )


def test_closed_days_leave_out_open_ones(spark, tmp_path, table):
    for k, day in enumerate((1, 2, 9)):
        table(
            "source int, target int, stratum string, seen_at timestamp_ntz", [(1, 2, "s1", DAY.replace(day=day))] * 2
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = mentions.closed_days(mentions.read_mentions(spark, str(tmp_path / "in"), 1))
    q = out.writeStream.outputMode("append").format("memory").queryName("closed").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["day"].day for r in spark.table("closed").collect()} <= {1, 2}
