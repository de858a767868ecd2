"""Where staged tables go."""

from types import SimpleNamespace

import pytest

from sessionlake.session import NoSharedFolder, remove_folder, stage, staging_folder, staging_root


class Unset:
    """A session that names no checkpoint folder."""

    def __init__(self, spark, master=None):
        context = spark.sparkContext
        self.conf = self
        self.sparkContext = SimpleNamespace(
            applicationId=context.applicationId, master=master or context.master
        )

    def get(self, key, default=None):
        return default


def test_folder_of_the_cluster_comes_first(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        assert staging_root(spark) == named.rstrip("/")


def test_own_folder_where_none_is_named(spark):
    own = staging_root(Unset(spark))
    assert own == staging_root(Unset(spark)) and "sessionlake-" in own


def test_staged_rows_come_back(spark):
    assert stage(spark.range(5), "numbers").count() == 5


def test_a_cluster_without_shared_folder_is_refused(spark):
    with pytest.raises(NoSharedFolder):
        staging_root(Unset(spark, "spark://host:7077"))


def test_staged_folders_can_be_removed(spark):
    folder = staging_folder(spark)
    stage(spark.range(5), "numbers", folder)
    remove_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/numbers")
