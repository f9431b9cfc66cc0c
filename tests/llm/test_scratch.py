import pytest

from millrace.llm import scratch


def test_settings_are_left_as_they_were(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for value in (None, "77"):
        if value:
            spark.conf.set(key, value)
        df = scratch.save(scratch.map_batches(spark.range(2000), lambda batches: batches, "id long"), "test")
        assert spark.conf.get(key, None) == value and df.count() == 2000
        scratch.discard(df)
        with pytest.raises(Exception):  # noqa: B017
            df.count()
    spark.conf.unset(key)


def test_marked_plans_are_discarded_with_their_tables(spark):
    table = scratch.save(spark.range(5), "test")
    plan = scratch.resting_on(table.where("id > 1"), table)
    assert plan.count() == 3
    scratch.discard(plan)
    with pytest.raises(Exception):  # noqa: B017
        plan.count()


def test_a_shared_folder_is_needed_on_clusters(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session())
    Context.getConf = lambda self: {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert scratch.scratch_root(Session()) == "hdfs:///shared"


def test_batches_are_small_and_unused_names_are_new(spark):
    sizes = scratch.map_batches(spark.range(3000).coalesce(1), lambda batches: (b.slice(0, 1).append_column("n", __import__("pyarrow").array([b.num_rows])) for b in batches), "id long, n long")
    assert max(r["n"] for r in sizes.collect()) <= scratch.BATCH_ROWS
    assert scratch.unused("row", ["ROW", "row_"]) == "row__"
