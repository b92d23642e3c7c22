"""The matrix source and sink against NumPy's own reading and writing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexengine.sources import matrices, paths


def saved(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, m in files.items():
        np.save(folder / f"{name}.npy", m)
    return str(folder)


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<f2", "<i4", "|u1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_row_ranges_of_all_kinds(spark, tmp_path, dtype, order):
    m = np.asarray((np.random.default_rng(1).random((37, 5)) * 100).astype(dtype), order=order)
    path = saved(tmp_path / "m", a=m)
    rows = matrices.read_npy(spark, f"{path}/a.npy", bytes_per_task=3 * 5 * m.dtype.itemsize)
    assert rows.rdd.getNumPartitions() == 13
    got = rows.orderBy("pos").collect()
    assert [r.row for r in got] == [r.pos for r in got] == list(range(37))
    assert np.array_equal(np.array([r.embedding for r in got], dtype=np.float32), m.astype(np.float32))


def test_a_folder_is_one_matrix(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.random((4, 3), np.float32), rng.random((6, 3), np.float32)
    path = saved(tmp_path / "m", b=b, a=a, none=np.zeros((0, 3), np.float32))
    got = matrices.read_npy(spark, "file://" + path, bytes_per_task=24).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(10)) and np.array_equal([r.embedding for r in got], np.vstack([a, b]))
    assert matrices.read_npy(spark, f"{path}/none.npy").count() == 0
    assert matrices.read_npy(spark, f"{path}/[ab].npy").count() == 10


@pytest.mark.parametrize("bad", [np.zeros(3), np.zeros((2, 2, 2)), np.array([["a"]])])
def test_other_shapes_and_kinds_are_refused(spark, tmp_path, bad):
    path = saved(tmp_path / "m", a=bad)
    with pytest.raises(Exception, match="no matrix of numbers"):
        matrices.read_npy(spark, path).collect()


def test_cut_files_are_refused(spark, tmp_path):
    path = saved(tmp_path / "m", a=np.zeros((9, 4), np.float32))
    whole = (tmp_path / "m/a.npy").read_bytes()
    (tmp_path / "m/a.npy").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="shorter than its header says"):
        matrices.read_npy(spark, path).collect()


def table(spark, n, width=4):
    rows = spark.range(n).select((F.col("id") * 7919 % max(n, 1)).alias("pos"), F.concat(F.lit("w\n\"ā"), "id").alias("word"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")).alias("desc"))
    return rows.withColumn("embedding", F.array(*[(F.col("pos") * 10 + k).cast("float") for k in range(width)])).repartition(5)


def test_written_matrices_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = table(spark, 101)
    matrices.write_matrix(rows, path, "m", "p", "s")
    back = matrices.read_matrix(spark, path, "word string, desc string")
    key = lambda r: (r.pos, r.word, r.desc, tuple(r.embedding))
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))
    # header and shards make a file that NumPy reads
    manifest = json.loads((tmp_path / "out" / matrices.MANIFEST).read_text())
    (tmp_path / "whole.npy").write_bytes((tmp_path / "out" / matrices.HEADER).read_bytes() + b"".join((tmp_path / "out" / s["values"]).read_bytes() for s in manifest["shards"]))
    whole = np.load(tmp_path / "whole.npy")
    assert whole.shape == (101, 4) and np.array_equal(whole[:, 0], np.arange(101) * 10)
    assert json.loads((tmp_path / "out/meta.json").read_text())["num_entries"] == 101


def test_writing_again_replaces_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (50, 20, 0):
        matrices.write_matrix(table(spark, n), path, "m", "p", "s")
        assert matrices.read_matrix(spark, path, "word string").count() == n
        manifest = json.loads((tmp_path / "out" / matrices.MANIFEST).read_text())
        data = {f.name for f in (tmp_path / "out").iterdir() if f.suffix in (".f32",)}
        assert data == {s["values"] for s in manifest["shards"]}


def test_failed_jobs_leave_the_old_matrix(spark, tmp_path):
    path = str(tmp_path / "out")
    matrices.write_matrix(table(spark, 30), path, "m", "p", "s")
    uneven = table(spark, 30).withColumn("embedding", F.when(F.col("pos") % 2 == 0, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    for bad in (uneven, table(spark, 30).withColumn("embedding", F.when(F.col("pos") != 7, F.col("embedding")))):
        with pytest.raises(Exception, match="rows without vector|different lengths"):
            matrices.write_matrix(bad, path, "m", "p", "s")
        assert matrices.read_matrix(spark, path, "word string").count() == 30
    with pytest.raises(Exception, match="not added to"):
        table(spark, 3).select(F.to_json(F.struct("word")).alias("entry"), "embedding").write.format("npy").mode("append").save(path)
    assert matrices.read_matrix(spark, path, "word string").count() == 30


def test_aborted_shards_are_in_no_matrix(tmp_path):
    writer = matrices.MatrixWriter(str(tmp_path), {}, True)
    for n in (1, 2):
        paths.write_bytes(str(tmp_path / f"v{n}"), [b"\0" * 8])
        paths.write_bytes(str(tmp_path / f"e{n}"), [b"{}"])
    shards = [matrices.Shard(n, 1, 2, f"v{n}", f"e{n}") for n in (1, 2)]
    writer.abort([shards[0], None])
    writer.commit([shards[1], None])
    assert {f.name for f in tmp_path.iterdir()} == {"v2", "e2", matrices.HEADER, matrices.META, matrices.MANIFEST}
    assert [m.rows for m in matrices.matrices_at(str(tmp_path))] == [1]
