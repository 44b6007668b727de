import os

import pytest

from millrace import scratch


def test_scratch_follows_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    path = scratch.new_dir(spark, "x")
    assert path.startswith(root + "/x-") and path != scratch.new_dir(spark, "x")


def test_materialized_rows_can_be_removed(spark):
    df = scratch.materialize(spark.range(10), "ten")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    folder = os.path.dirname(df.inputFiles()[0].replace("file://", ""))
    assert scratch.remove_scratch(spark, folder) and not os.path.exists(folder)
    for outside in ("/etc", spark.conf.get("spark.checkpoint.dir") + "/../x"):
        with pytest.raises(ValueError):
            scratch.remove_scratch(spark, outside)


def test_a_cluster_needs_the_setting():
    class Conf(dict):
        pass

    class Context:
        master = "spark://somewhere"

        @staticmethod
        def getConf():
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session())


def test_scope_deletes_what_is_not_kept(spark):
    import os

    from millrace.scratch import materialize, scratch_scope

    with scratch_scope(spark) as keep:
        first = materialize(spark.range(5), "first")
        second = materialize(first.where("id > 2"), "second")
        keep += {os.path.dirname(f) for f in second.inputFiles()}
        keep[:] = [k.removeprefix("file://") for k in keep]
        gone = [os.path.dirname(f).removeprefix("file://") for f in first.inputFiles()]
    assert second.count() == 2 and not any(os.path.exists(g) for g in gone)
