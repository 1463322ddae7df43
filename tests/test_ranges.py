"""Range operators against nested loops, whatever the bin size."""

import random

import pytest

from regionframe.functions.aggregates import Agg
from regionframe.model import Dataset
from regionframe.plans.ranges import distance

COLUMNS = "sample_id long, chrom string, left long, right long, strand string, v double, t string"


def make(spark, rows, name, samples=(1, 2)):
    meta = [(s, "cell", f"c{s % 2}") for s in samples] or [(0, "x", "y")]
    m = spark.createDataFrame(meta, "sample_id long, attribute string, value string")
    return Dataset.of(spark.createDataFrame(rows, COLUMNS), m if samples else m.limit(0), name)


EDGES = [
    (1, "a", 0, 10, "+", 1.0, "x"), (1, "a", 10, 20, "-", None, None), (1, "a", 2, 5, "*", 2.0, "y"), (1, "a", 2, 5, "*", 2.0, "y"), (1, "a", 7, 8, "+", 3.0, "z"), (2, "a", 7, 7, "*", 4.0, "x"),
    (2, "a", 93, 107, "-", 5.0, "x"), (2, "b", 100, 200, "*", 6.0, "x"), (2, "b", 0, 350, "+", 7.0, "."), (1, "b", 199, 200, "-", 8.0, "w"), (1, "b", 350, 351, "+", 9.0, "w"),
]


def drawn(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        left = r.randrange(0, 300)
        out.append((r.choice((1, 2)), r.choice("ab"), left, left + r.randrange(1, 60), r.choice("+-*"), r.choice((None, 1.0, 2.5)), r.choice(("x", "y", None))))
    return out


def near(a, b):
    return a[1] == b[1] and (a[4] == "*" or b[4] == "*" or a[4] == b[4])


def laps(a, b):
    return near(a, b) and a[2] < b[3] and b[2] < a[3]


def gap(a, b):
    g = min(abs(a[2] - b[3]), abs(b[2] - a[3]))
    return g if a[3] < b[2] or b[3] < a[2] else -g


def sort(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("bins", [7, 100, 5000])
@pytest.mark.parametrize("left, right", [(EDGES, EDGES), (drawn(1), drawn(2))])
def test_map(spark, left, right, bins):
    got = make(spark, left, "L").map(make(spark, right, "R"), [Agg("SUM", "v"), Agg("MEDIAN", "v"), Agg("BAG", "t")], count_name="n", bin_size=bins).regions.collect()
    want = []
    for key in set(left):
        for exp in (1, 2):
            met = [b for b in right for _ in range(left.count(key)) if b[0] == exp and laps(key, b)]
            v = sorted(b[5] for b in met if b[5] is not None)
            bag = ",".join(sorted(b[6] if b[6] is not None else "." for b in met)) or "."
            want.append((*key[1:], float(len(met)), sum(v) if v else None, v[(len(v) - 1) // 2] if v else None, bag))
    assert sort(tuple(r)[1:] for r in got) == sort(want)


@pytest.mark.parametrize("bins", [7, 100, 5000])
@pytest.mark.parametrize("exact", [False, True])
def test_difference(spark, bins, exact):
    left, right = EDGES + drawn(3), drawn(4) + EDGES[:3]
    got = make(spark, left, "L").difference(make(spark, right, "R"), exact=exact, bin_size=bins).regions.collect()
    hit = (lambda a, b: near(a, b) and a[2:4] == b[2:4]) if exact else laps
    want = [a[1:] for a in set(left) if not any(hit(a, b) for b in right)]
    assert sort(tuple(r)[1:] for r in got) == sort(want)


@pytest.mark.parametrize("bins", [7, 5000])
@pytest.mark.parametrize("condition", [[("DLE", 0)], [("DLE", 12), ("DGE", 1)], [("DL", -1)], [("DLE", 20), ("UP",)], [("DLE", 20), ("DOWN",)], [("MD", 1)], [("MD", 2), ("DG", 0)], [("UP",), ("MD", 1)]])
def test_join(spark, condition, bins):
    left, right = drawn(5, 40), drawn(6, 40)
    got = make(spark, left, "L").join(make(spark, right, "R"), condition, output="LEFT", max_distance=50, bin_size=bins).regions.collect()

    def holds(atom, a, b):
        d = gap(a, b)
        if atom[0] in ("DL", "DLE", "DG", "DGE"):
            return {"DL": d < atom[1], "DLE": d <= atom[1], "DG": d > atom[1], "DGE": d >= atom[1]}[atom[0]]
        before, after = b[3] <= a[2], b[2] >= a[3]
        return (after if a[4] == "-" else before) if atom[0] == "UP" else (before if a[4] == "-" else after)

    md = next((k for k, x in enumerate(condition) if x[0] == "MD"), len(condition))
    first, second = condition[:md], condition[md + 1 :]
    radius = 50 if md < len(condition) and not any(x[0] in ("DL", "DLE") for x in first) else 10**9
    want = []
    for a in set(left):
        for exp in (1, 2):
            met = [b for b in right for _ in range(left.count(a)) if b[0] == exp and near(a, b) and gap(a, b) <= radius and all(holds(x, a, b) for x in first)]
            if md < len(condition):
                d = sorted(gap(a, b) for b in met)
                met = [b for b in met if sum(x < gap(a, b) for x in d) < condition[md][1]]
            want += [(*a[1:], b[5], b[6]) for b in met if all(holds(x, a, b) for x in second)]
    assert sort(tuple(r)[1:] for r in got) == sort(want)


def depth(rows, chrom, strand, x):
    return sum(r[1] == chrom and (strand == "*" or r[4] == strand) and r[2] <= x < r[3] for r in rows)


@pytest.mark.parametrize("part", [13, 10**6])
@pytest.mark.parametrize("variant, low, high", [("cover", 2, 3), ("cover", 1, "ANY"), ("histogram", 1, 4), ("summit", 2, 3), ("summit", 1, "ANY"), ("flat", 2, "ANY")])
@pytest.mark.parametrize("strands", ["*", "+-"])
def test_cover(spark, variant, low, high, strands, part):
    rows = [r if strands == "*" else (*r[:4], "+" if r[4] == "*" else r[4], *r[5:]) for r in drawn(7, 50)]
    if strands == "*":
        rows = [(*r[:4], "*", *r[5:]) for r in rows]
    got = make(spark, rows, "L").cover(low, high, variant=variant, bin_size=50, part=part).regions.collect()
    top = 10**9 if high == "ANY" else high
    ok = lambda d: d > 0 and low <= d <= top
    want = []
    for chrom in "ab":
        for strand in strands:
            mine = [r for r in rows if r[1] == chrom and (strand == "*" or r[4] == strand)]
            runs = []
            for x in range(400):
                d = depth(rows, chrom, strand, x)
                if runs and runs[-1][2] == d:
                    runs[-1][1] = x + 1
                else:
                    runs.append([x, x + 1, d])
            d = [r[2] for r in runs]
            if variant in ("cover", "flat"):
                found, k = [], 0
                while k < len(runs):
                    if ok(d[k]):
                        e = k
                        while e + 1 < len(runs) and ok(d[e + 1]):
                            e += 1
                        found.append((runs[k][0], runs[e][1], max(d[k : e + 1])))
                        k = e
                    k += 1
            else:
                found = []
                for k, (a, b, x) in enumerate(runs):
                    p, n = d[k - 1] if k else 0, d[k + 1] if k + 1 < len(d) else 0
                    summit = (x > p and (n < x or not ok(n))) or (not ok(p) and n < x)
                    if ok(x) and (variant == "histogram" or summit):
                        found.append((a, b, x))
            for a, b, x in found:
                on = [r for r in mine if r[2] < b and a < r[3]]
                lo, hi = min(r[2] for r in on), max(r[3] for r in on)
                common = max(0, min(r[3] for r in on) - max(r[2] for r in on))
                ends = (lo, hi) if variant == "flat" else (a, b)
                want.append((chrom, *ends, strand, float(x), round((b - a) / (hi - lo), 6), round(common / (hi - lo), 6)))
    assert sort((*tuple(r)[1:6], round(r[6], 6), round(r[7], 6)) for r in got) == sort(want)


def test_empty_right(spark):
    left, empty = make(spark, EDGES, "L"), make(spark, [], "R", ())
    assert left.difference(empty).regions.count() == 0
    assert left.map(empty).regions.count() == 0
    assert left.join(empty, [("DLE", 5)]).regions.count() == 0
    assert empty.cover(1, "ANY").regions.count() == 0


def test_distance_is_a_column():
    assert "least" in str(distance()).lower()


def test_histogram_keeps_length(spark):
    rows = drawn(8)
    out = make(spark, rows, "L").histogram(1, "ANY").regions.collect()
    assert sum((r["right"] - r["left"]) * r["AccIndex"] for r in out) == sum(r[3] - r[2] for r in rows)
