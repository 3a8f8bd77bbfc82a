"""Streamed threshold bars equal those of the batch fold."""

from tickfold.sources.ticks import event_ticks
from tickfold.streaming import bars as S


def test_threshold_bars_of_a_stream(spark, tmp_path):
    ticks = event_ticks(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("symbol = 'click'")
    rows = ticks.orderBy("us").toPandas()
    for i, part in enumerate((rows[:40], rows[40:90], rows[90:])):
        spark.createDataFrame(part, ticks.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(ticks.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limit = int(rows.dollar.sum() // 20)
    query = S.threshold_bars(stream, limit).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("bars").orderBy("bar_idx").collect()
    run = rows.dollar.cumsum() // limit
    want = rows.groupby(run).agg(open=("price", "first"), close=("price", "last"), n=("price", "size"))
    assert [(r.bar_idx, r.open, r.close, r.n_base) for r in got] == [(k, *w) for k, w in zip(want.index, want.itertuples(index=False))][:-1]
