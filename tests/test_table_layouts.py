"""Queries over tables that lie as folders of parts, as large tables do."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables of SF with documents, conversations and events in three parts each."""
    d = tmp_path_factory.mktemp("parts")
    for name in os.listdir(SF):
        if name.split(".")[0] in ("documents", "conversations", "events"):
            spark.read.parquet(f"{SF}/{name}").repartition(3).write.parquet(f"{d}/{name}")
        else:
            os.symlink(f"{SF}/{name}", d / name)
    return str(d)


@pytest.mark.parametrize("name", ["message_stream", "new_file_stream", "refresh_stream", "floor_stream"])
def test_streams_read_folders_of_parts(spark, parts, name):
    query = entry.queries()[name]
    one, many = (sorted(map(tuple, query(spark, sf).collect()), key=str) for sf in (SF, parts))
    assert one and one == many
