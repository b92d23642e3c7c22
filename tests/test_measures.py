"""Measures that are taken while a job runs."""

from pyspark.sql import functions as F

from lexengine.functions.measure import Measure, progress
from lexengine.streaming import streams


def test_rows_seconds_and_rate_of_one_write(spark, tmp_path):
    measure, read = Measure("m"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(1000, numPartitions=4).mapInArrow(seen, "id bigint")
    with measure.running():
        measure.of(rows, total=F.sum("id")).write.parquet(str(tmp_path / "out"))
    found = measure.result(32)
    assert (found["rows"], found["total"], found["batches"]) == (1000, 499_500, 32)
    assert found["seconds"] > 0 and abs(found["rate"] - 1000 / found["seconds"]) < 1e-6
    # nothing was read twice
    assert read.value == 1000


def test_progress_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in (3, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(folder)
    query = streams.run_available(streams.read_files(spark, folder, "id bigint"), str(tmp_path / "cp"), lambda b, _: b.count())
    got = progress(query)
    assert sorted(p["rows"] for p in got) == [3, 5] and all(p["seconds"] > 0 for p in got)
