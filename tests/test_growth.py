"""What grows with the regions: plans that move, sort or repeat no more than they need, and the same results."""

import random

import pytest

from regionframe.functions.aggregates import Agg
from regionframe.plans.ranges import segments
from regionframe.sources.readers import Parser, lines, parser_of
from regionframe.sources.schema import Schema
from test_ranges import drawn, gap, make, near, sort


@pytest.fixture
def plan(spark):
    """Plans where nothing is broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def pair(spark):
    return make(spark, drawn(1), "L"), make(spark, drawn(2), "R")


@pytest.mark.parametrize("condition", [[("MD", 1)], [("DLE", 40), ("DG", 3), ("MD", 1), ("UP",)]])
def test_nearest_sorts_no_pairs(spark, plan, condition):
    x, y = pair(spark)
    found = plan(x.join(y, condition, output="RIGHT", max_distance=50).regions)
    assert "Window" not in found and "out_id" not in found.split("Join", 1)[1]


def test_nearest_cuts_before_it_ranks(spark, plan):
    x, y = pair(spark)
    found = plan(x.join(y, [("MD", 2)], output="RIGHT", max_distance=50).regions)
    assert "__bound" in found and "Exchange" not in found.split("Window", 1)[1].split("SortMergeJoin", 1)[0]


def long_and_equal(seed):
    r = random.Random(seed)
    out = drawn(seed, 40)
    out += [(*x[:3], x[2] + r.choice((1, 90, 400, 3000)), *x[4:]) for x in out[:12]]
    return out + out[5:20] + out[5:9]


@pytest.mark.parametrize("bins, k, joinby", [(100, 1, None), (100, 2, ["cell"]), (5000, 3, None), (7, 20, None)])
def test_nearest(spark, bins, k, joinby):
    left, right = long_and_equal(11), long_and_equal(12)
    got = make(spark, left, "L").join(make(spark, right, "R"), [("DLE", 60), ("DG", -30), ("MD", k)], joinby, output="BOTH", bin_size=bins).regions.collect()
    want = []
    for a in set(left):
        for exp in (1, 2):
            if joinby and exp != a[0]:
                continue
            met = [b for b in right for _ in range(left.count(a)) if b[0] == exp and near(a, b) and -30 < gap(a, b) <= 60]
            d = [gap(a, b) for b in met]
            met = [b for b in met if sum(x < gap(a, b) for x in d) < k]
            want += [(*a[1:], b[1], float(b[2]), float(b[3]), *b[4:]) for b in met]
    assert sort(tuple(r)[1:] for r in got) == sort(want)


def test_distance_join_moves_no_pairs(spark, plan):
    x, y = pair(spark)
    found = plan(x.join(y, [("DL", 40), ("DG", 5)], output="CAT").regions)
    assert found.count("SortMergeJoin") == 1 and "CartesianProduct" not in found


def test_map_copies_regions_where_they_are(spark, plan):
    x, y = pair(spark)
    assert "SortMergeJoin [sample_id" not in plan(x.map(y, [Agg("BAG", "t")]).regions)


@pytest.mark.parametrize("operator", ["map", "difference"])
def test_partners_are_spread(spark, plan, operator):
    x, y = pair(spark)
    found = plan(getattr(x, operator)(y, joinby=["cell"]).regions)
    assert "SortMergeJoin [sample_id" in found and "hashpartitioning(sample_id#" in found
    assert all("__part" in row for row in found.splitlines() if "SortMergeJoin [sample_id" in row)


def test_metadata_goes_to_regions(spark, plan):
    x, _ = pair(spark)
    assert "SortMergeJoin" not in plan(x.select(region=("cmp", ("field", "v"), ">", ("meta", "cell"))).regions)


def test_cover_groups_regions_where_they_are(spark, plan):
    x, _ = pair(spark)
    assert "SortMergeJoin [sample_id" not in plan(x.cover(2, "ANY", ["cell"]).regions)


def test_segments_scan_regions_once(spark, plan):
    x, _ = pair(spark)
    found = plan(segments(x.regions, ("chrom", "strand"), 100))
    assert "Union" not in found


@pytest.mark.parametrize("parser", [Parser(others=((3, "v", "DOUBLE"), (4, "w", "DOUBLE"))), parser_of(Schema("x", (("v", "DOUBLE"), ("w", "DOUBLE")), "gtf"))])
def test_a_line_is_split_once(spark, parser):
    raw = spark.createDataFrame([(1, "a")], "sample_id long, value string")
    found = lines(raw, parser)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("split(") == 1
    assert found.count("regexp_extract(") == (2 if parser.kind == "gtf" else 0)


def test_numbers_keep_their_text(spark):
    from regionframe.functions.text import number_text
    from pyspark.sql import functions as F

    values = [0.0, -0.0, 10.0, 100.5, 1e-8, 1.5e-7, 1e-9, -2.5, 1200000.0, 1e30, float("nan"), None, 0.1234567891]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(number_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows[:4]] == ["0", "0", "10", "100.5"] and rows[7]["t"] == "-2.5" and rows[8]["t"] == "1200000" and rows[12]["t"] == "0.12345678"
