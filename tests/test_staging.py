"""Written tables live as long as a DataFrame reaches them."""

import os
from types import SimpleNamespace

import pytest

from pointloom.plans import staging


def there(path):
    return os.path.isdir(path.removeprefix("file:"))


def test_tables_go_when_nothing_reaches_them(spark):
    a = staging.written(spark.range(100).selectExpr("id", "id % 7 AS k"), "a")
    path = a._written_to
    joined = a.groupBy("k").count().join(a, "k").select("id", "count")
    del a
    staging.tidy(spark)
    assert there(path) and joined.count() == 100
    other = staging.written(joined, "b")
    del joined
    staging.tidy(spark)
    staging.tidy(spark)
    assert not there(path) and there(other._written_to) and other.count() == 100


def test_discarded_tables_go_at_once(spark):
    a = staging.written(spark.range(3), "a")
    path = a._written_to
    staging.discard(a)
    staging.discard(a)
    assert not there(path)


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(applicationId="app-without-folder", master="spark://somewhere:7077", getConf=lambda: SimpleNamespace(get=lambda _: None))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.scratch_dir(session)


def test_bytes_are_put_anywhere(spark):
    path = staging.new_path(spark, "bytes") + "/x.bin"
    staging.put_bytes(spark, path, b"\x00\xffabc")
    assert bytes(spark.read.format("binaryFile").load(path).first()["content"]) == b"\x00\xffabc"
