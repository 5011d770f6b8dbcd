"""What the operators share: staged tables and the session's settings."""

import os

import pytest

from perilune.llm import common

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_staging_keeps_settings_and_rows(spark):
    old = spark.conf.get(ROWS), spark.conf.get(BYTES)
    try:
        spark.conf.set(ROWS, "100")
        spark.conf.set(BYTES, "1m")
        common.ready(spark)
        rows = common.staged(spark.range(10), batch=3)
        assert rows.count() == 10 and (spark.conf.get(ROWS), spark.conf.get(BYTES)) == ("100", "1m")
        for large in ("10000", "0"):
            spark.conf.set(ROWS, large)
            common.ready(spark)
            assert spark.conf.get(ROWS) == "512"
    finally:
        spark.conf.set(ROWS, old[0])
        spark.conf.set(BYTES, old[1])


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        applicationId = "a"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1000]"):
        Context.master = master
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Session())
    for master in ("local", "local[*]", "local[4]"):
        Context.master = master
        assert common.shared_dir(Session()).startswith("file:///tmp/checkpoints/")


def test_what_was_staged_can_be_removed(spark):
    path = os.path.dirname(common.shared_dir(spark)).removeprefix("file://")
    held = common.staged(spark.range(3))
    assert held.count() == 3 and os.path.isdir(path)
    other = os.path.dirname(path) + "/other"
    os.makedirs(other)
    app = spark.sparkContext.applicationId
    assert path.endswith(app)
    common.cleaned(spark)
    assert not os.path.exists(path) and os.path.isdir(other)
