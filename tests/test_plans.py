"""What the plans must and must not hold: pruned and filtered scans, equi-joins, no row-at-a-time Python."""

import re

import pytest

from tickloom.operators import etl, quality
from tickloom.plans import registry
from tickloom.sources.tape import read_tape

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 1.0, 1.0)], "timestamp long, side byte, price double, quantity double")
    rows.write.parquet(str(tmp_path / "t"))
    scan = plan(spark.read.parquet(str(tmp_path / "t")).where("side = 2 AND timestamp >= 1 AND timestamp < 9").groupBy().count())
    assert re.search(r"PushedFilters: \[.*EqualTo\(side,2\)", scan) and re.search(r"GreaterThanOrEqual\(timestamp,1\)", scan)
    wide = plan(quality.side_distribution(read_tape(spark, str(tmp_path / "t")), ["symbol"]))
    assert "price" not in re.search(r"ReadSchema: (\S+)", wide)[1]


def test_days_are_pruned_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([("S", d, 1, 2, 1.0, 1.0) for d in ("20240101", "20240102")], "symbol string, day string, timestamp long, side byte, price double, quantity double")
    etl.write_day(rows, str(tmp_path / "t"), ["symbol", "day"])
    back = spark.read.parquet(str(tmp_path / "t")).where("day = 20240102")
    assert "PartitionFilters" in plan(back) and back.count() == 1


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_product_and_no_row_at_a_time_python(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p
    # a nested loop is only the join with a single row of totals
    for part in re.findall(r"BroadcastNestedLoopJoin[^\n]*", p):
        assert "Cross" in part or "Inner" in part


@pytest.mark.parametrize("name", ["book_top1_at_trade", "trade_flow_window", "gap_stats"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, name):
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, registry.queries()[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]
