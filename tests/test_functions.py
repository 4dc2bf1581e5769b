from types import SimpleNamespace

import pytest

from newsloom.functions import sizing, staging


def fake_session(master, setting):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", directory=None)
    context.getCheckpointDir = lambda: context.directory
    context.setCheckpointDir = lambda path: setattr(context, "directory", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: setting or default))


def test_named_folder_is_used():
    session = fake_session("yarn", "hdfs:///shared")
    assert staging.shared_dir(session) == "hdfs:///shared"
    assert session.sparkContext.directory == "hdfs:///shared"
    paths = {staging.scratch_path(session, "t") for _ in range(3)}
    assert len(paths) == 3 and all(p.startswith("hdfs:///shared/newsloom/") for p in paths)


def test_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(fake_session("yarn", None))


def test_local_master_gets_one_folder():
    session = fake_session("local[2]", None)
    assert staging.shared_dir(session) == staging.shared_dir(session)


def test_size_is_checked(spark):
    rows = spark.range(100).selectExpr("id", "repeat('x', 10) as s")
    assert sizing.is_small(rows)
    assert not sizing.is_small(rows, max_rows=99)
    assert not sizing.is_small(rows, max_bytes=1_000)
    assert sizing.is_small(rows.where("id < 0"))
    assert not sizing.is_small(rows.selectExpr("array(s) as a"))


def test_large_tables_are_an_error(spark):
    assert sizing.require_small(spark.range(3), "a list").count() == 3
    with pytest.raises(ValueError, match="a list is sent to every task"):
        sizing.require_small(spark.range(3), "a list", max_rows=2)


def test_staged_table_has_no_lineage(spark):
    staged = staging.stage(spark.range(5).selectExpr("id", "array(id) as a"), "t")
    assert staged.count() == 5 and "Range" not in staged._jdf.queryExecution().toString()
    assert staging.stage(spark.range(0), "empty").count() == 0


def sizes_of_batches(docs):
    def count(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    return [(r.n, r.size) for r in docs.mapInArrow(count, "n long, size long").collect()]


def test_rows_go_to_python_in_small_batches(spark):
    docs = spark.range(2000).selectExpr("repeat('word ', if(id = 5, 2000000, 2000)) AS text").coalesce(1)
    with staging.small_batches(spark):
        found = sizes_of_batches(docs)
    assert sum(n for n, _ in found) == 2000
    assert len(found) > 4 and sorted(size for _, size in found)[-2] < 2 * staging.BATCH_BYTES
    assert spark.conf.get(staging.BATCH_SETTING, None) is None


def test_a_session_keeps_its_own_bound_of_batches(spark):
    spark.conf.set(staging.BATCH_SETTING, "1m")
    try:
        with staging.small_batches(spark):
            assert spark.conf.get(staging.BATCH_SETTING) == "1m"
        assert spark.conf.get(staging.BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(staging.BATCH_SETTING)
    with pytest.raises(ZeroDivisionError), staging.small_batches(spark):
        1 / 0
    assert spark.conf.get(staging.BATCH_SETTING, None) is None
