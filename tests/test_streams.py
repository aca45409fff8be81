"""Streams over tables that are folders of files, as larger tables are."""

import pytest
from test_queries import rows

from glimmer.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_scoring", "stream_tumbling", "stream_sliding", "stream_session", "stream_running_median"])
def test_folder_gives_what_the_file_gives(spark, tmp_path, name):
    for t in ("embeddings", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    query = registry.queries()[name]
    want, got = query(spark, SF), query(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and got.count() > 0
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, [tuple(r) for r in want.collect()])


def test_scoring_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()["stream_scoring"](spark, str(tmp_path)).count() == 0
