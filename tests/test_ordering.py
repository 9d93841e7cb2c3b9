import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clustrum.operators.ordering import describe, global_index, rows_at_ranks, running_sums


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randrange(40), rng.randrange(1, 9)) for i in range(900)]
    return pd.DataFrame(rows, columns=["id", "g", "v", "w"])


def test_global_index_matches_sort(spark, skewed):
    out = global_index(spark.createDataFrame(skewed), ["v", "id"]).toPandas()
    expected = skewed.sort_values(["v", "id"]).id.tolist()
    assert out.sort_values("row_index").id.tolist() == expected
    assert sorted(out.row_index) == list(range(900))


def test_running_sums_restart_per_group_and_cross_partitions(spark, skewed):
    out = running_sums(
        spark.createDataFrame(skewed).repartition(7), ["v", "id"], ["w"], ["g"], previous="v"
    ).toPandas().sort_values(["g", "v", "id"])
    expected = skewed.sort_values(["g", "v", "id"])
    assert out.cum_w.tolist() == expected.groupby("g").w.cumsum().tolist()
    before = expected.groupby("g").v.shift().tolist()
    assert [None if pd.isna(x) else x for x in out.previous_v] == [None if pd.isna(x) else x for x in before]


def test_running_sums_small_arrow_batches(spark, skewed):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        test_running_sums_restart_per_group_and_cross_partitions(spark, skewed)
    finally:
        spark.conf.unset(key)


def test_describe_equals_numpy(spark, skewed):
    out = describe(spark.createDataFrame(skewed), "v", ["g"], (0, 0.05, 0.25, 0.5, 0.95, 1)).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        assert out.loc[g, "count"] == len(part)
        assert out.loc[g, "std_population"] == pytest.approx(np.std(part.v))
        for f, name in [(0, "min"), (0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.95, "p95"), (1, "max")]:
            assert out.loc[g, name] == pytest.approx(np.quantile(part.v, f))


def test_rows_at_ranks(spark, skewed):
    df = spark.createDataFrame(skewed)
    ordered = list(skewed.sort_values(["v", "id"])[["v", "id"]].itertuples(index=False, name=None))
    assert rows_at_ranks(df, "v", "id", [0, 17, 540, 899]) == [ordered[r] for r in (0, 17, 540, 899)]


def test_intermediate_tables_go_to_the_configured_folder(spark):
    import os

    from clustrum.session import bounded_collect, checked_broadcast, materialize, shared_dir

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert shared_dir(spark) == folder and materialize(spark.range(3), "written").count() == 3
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["written"]
    plan = lambda df: df._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in plan(checked_broadcast(spark.range(5)))
    assert "broadcast" not in plan(checked_broadcast(spark.range(5), max_bytes=4))
    with pytest.raises(ValueError):
        bounded_collect(spark.range(5), 4, "rows")
