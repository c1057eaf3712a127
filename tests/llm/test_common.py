from types import SimpleNamespace

import pytest

from timelineql.llm.common import Scratch, shared_dir


def session(master, found=None, app="app-1"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: found if key == "spark.checkpoint.dir" and found else default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_the_shared_folder_is_the_session_s_or_one_of_our_own_on_one_machine():
    assert shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    own = shared_dir(session("local[2]"))
    assert own.startswith("file:///") and shared_dir(session("local[2]")) == own != shared_dir(session("local[2]", app="app-2"))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))


def test_scratch_tables_are_written_read_and_dropped(spark):
    s = Scratch(spark)
    df = s.save(spark.range(5), "five")
    assert df.count() == 5 and s.home.startswith(shared_dir(spark)) and "five" in df.inputFiles()[0]
    s.drop("five")
    with pytest.raises(Exception):
        spark.read.parquet(f"{s.home}/five").count()
