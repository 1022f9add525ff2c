"""S3: snapshots follow the files they were made from."""
import os

import pytest
from pyspark.sql import functions as F

from basketlens.sources import snapshots as SN
from basketlens.sources.sqlrun import sql_to_df


def _table(spark, path, n, **kw):
    spark.range(n).selectExpr("id", "id * 2 as v").write.mode("overwrite").parquet(path, **kw)
    return spark.read.parquet(path)


def test_rewriting_an_input_file_changes_the_version(spark, tmpdir_path):
    a, b = f"{tmpdir_path}/a", f"{tmpdir_path}/b"
    df = _table(spark, a, 10).join(_table(spark, b, 5), "id")
    first = SN.source_version(spark, df)
    assert first == SN.source_version(spark, df) == SN.source_version(spark, spark.read.parquet(b), spark.read.parquet(a))
    _table(spark, b, 5)  # the same rows, written again
    second = SN.source_version(spark, df)
    spark.range(1).selectExpr("id", "id as v").write.mode("append").parquet(b)
    assert len({first, second, SN.source_version(spark, df)}) == 3
    assert SN.source_version(spark, spark.range(3)) == "none"
    with pytest.raises(SN.UnversionedSource):
        SN.source_version(spark, spark.createDataFrame([(1,)], "id long"))


def test_second_report_reads_the_snapshot(spark, tmpdir_path):
    src, built = f"{tmpdir_path}/src", []
    snaps = SN.Snapshots(spark, f"{tmpdir_path}/snaps")

    def get(**kw):
        df = spark.read.parquet(src)
        return snaps.get("doubled", lambda: built.append(1) or df.withColumn("w", F.col("v") + 1), [df], **kw)
    _table(spark, src, 10)
    assert get().count() == 10 and get().agg(F.max("w")).first()[0] == 19 and len(built) == 1
    assert get(params={"x": 1}).count() == 10 and len(built) == 2
    assert get(code="other code").count() == 10 and len(built) == 3
    _table(spark, src, 12)
    assert get().count() == 12 and len(built) == 4


def test_a_failed_or_lost_write_is_no_snapshot(spark, tmpdir_path):
    src = _table(spark, f"{tmpdir_path}/src", 4)
    snaps = SN.Snapshots(spark, f"{tmpdir_path}/snaps")
    with pytest.raises(Exception):
        snaps.get("s", lambda: src.withColumn("x", F.raise_error(F.lit("stop")).cast("int")), [src])
    assert snaps.get("s", lambda: src, [src]).count() == 4
    key = SN.snapshot_key("s", {}, SN.source_version(spark, src), SN.code_version())
    data = snaps.current("s", key)
    os.remove(f"{data}/_SUCCESS")  # as if the folder had been cleared
    assert snaps.current("s", key) is None
    assert snaps.get("s", lambda: src.limit(3), [src]).count() == 3


def test_two_writers_of_one_key(spark, tmpdir_path):
    src = _table(spark, f"{tmpdir_path}/src", 4)
    snaps = SN.Snapshots(spark, f"{tmpdir_path}/snaps")

    def slow():  # meanwhile another writer finishes
        snaps.get("s", lambda: src, [src])
        return src
    assert snaps.get("s", slow, [src]).count() == 4
    assert snaps.get("s", lambda: pytest.fail("made again"), [src]).count() == 4


def test_vacuum_keeps_what_is_current(spark, tmpdir_path):
    src = _table(spark, f"{tmpdir_path}/src", 4)
    snaps = SN.Snapshots(spark, f"{tmpdir_path}/snaps")
    snaps.get("s", lambda: src, [src])
    key = SN.snapshot_key("s", {}, SN.source_version(spark, src), SN.code_version())
    home = snaps.current("s", key).rsplit("/", 1)[0]
    src.write.parquet(f"{home}/data-left-over")
    assert snaps.vacuum(3600) == []
    os.utime(f"{home}/data-left-over", (0, 0))
    assert [p.rsplit("/", 1)[1] for p in snaps.vacuum(3600)] == ["data-left-over"]
    assert snaps.get("s", lambda: pytest.fail("made again"), [src]).count() == 4


def test_sql_result_is_kept_until_its_files_change(spark, tmpdir_path):
    src, root = f"{tmpdir_path}/src", f"{tmpdir_path}/snaps"
    sql = "select count(*) as N, max(id) as Top from snap_src where id between :low and :high"

    def run(**kw):
        return sql_to_df(spark, sql, low=1, high=8, cache_root=root, **kw)
    _table(spark, src, 5).createOrReplaceTempView("snap_src")
    df = run()
    assert tuple(df.first()) == (4, 4) and "snaps/sql-" in df.inputFiles()[0]
    assert run().inputFiles() == df.inputFiles()
    assert "snaps/sql-" not in run(use_cache=False).inputFiles()[0]
    _table(spark, src, 9).createOrReplaceTempView("snap_src")
    assert tuple(run().first()) == (8, 8)
    spark.createDataFrame([(1,)], "id long").createOrReplaceTempView("snap_src")
    assert tuple(run().first()) == (1, 1)


def test_sql_list_parameter(spark):
    spark.range(10).createOrReplaceTempView("nums3")
    df = sql_to_df(spark, "select id as ID from nums3 where array_contains(%(chosen)s, id)", chosen=[3, 5, 77])
    assert sorted(r.id for r in df.collect()) == [3, 5]
