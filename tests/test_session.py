import types

import pytest

from retentio import session


class Conf(dict):
    def get(self, k, d=None):
        return dict.get(self, k, d)

    def set(self, k, v):
        self[k] = v


def fake(master, conf=(), existing=None):
    made = []
    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else existing, setCheckpointDir=made.append)
    return types.SimpleNamespace(conf=Conf(conf), sparkContext=sc), made


def test_the_setting_then_the_contexts_folder_then_the_fallback():
    spark, made = fake("spark://x", {"spark.checkpoint.dir": "s3a://shared"}, None)
    assert session.checkpoint_dir(spark) == "s3a://shared" and made == ["s3a://shared"]
    spark, made = fake("spark://x", {}, "hdfs:///there")
    assert session.checkpoint_dir(spark) == "hdfs:///there" and made == []
    spark, made = fake("spark://x")
    assert session.checkpoint_dir(spark, "/given") == "/given" and made == ["/given"]


@pytest.mark.parametrize("master", ["spark://x", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_gets_no_local_folder(master):
    spark, made = fake(master)
    with pytest.raises(ValueError):
        session.checkpoint_dir(spark)
    assert made == []


def test_shuffle_partitions_are_set_only_when_given(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert session.get_spark().conf.get("spark.sql.shuffle.partitions") == "5"
        assert session.get_spark(shuffle_partitions=7).conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
