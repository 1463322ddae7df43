import pytest

from regionframe.functions.aggregates import Agg
from regionframe.lang import grammar as g
from regionframe.lang.script import Script
from regionframe.lang.tokens import ScriptError
from regionframe.model import Dataset

COLUMNS = "sample_id long, chrom string, left long, right long, strand string, score double, name string"


@pytest.fixture(scope="module")
def ann(spark):
    rows = [(1, "chr1", 10, 20, "+", 0.5, "geneA"), (1, "chr2", 15, 30, "-", 0.9, "geneB"), (2, "chr1", 12, 40, "*", None, "geneC"), (2, "chr1", 100, 120, "+", 0.1, "geneA")]
    meta = [(1, "cell", "K562"), (1, "cell", "h1"), (1, "average", "0.5"), (1, "antibody", "CTCF"), (2, "left.cell", "k562"), (2, "average", "1.0"), (2, "antibody", "BRD4")]
    return Dataset.of(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(meta, "sample_id long, attribute string, value string"), "ANN")


def run(ann, text):
    return Script({"ANN": ann}).run(text)


SCRIPTS = [
    ("A = SELECT(cell == 'k562') ANN;", 4), ("A = SELECT(cell == 'h1' AND average < 0.7) ANN;", 2), ("A = SELECT(NOT(cell == 'h1') OR antibody == '*') ANN;", 4), ("A = SELECT() ANN;", 4),
    ("A = SELECT(region: left > 12 AND NOT(name == 'geneC')) ANN;", 2), ("A = SELECT(region: chr == chr1; ) ANN;", 3), ("a = select(REGION: strand == - ) ANN;", 1), ("A = SELECT(region: score > META(average)) ANN;", 1),
    ("X = SELECT(antibody == 'CTCF') ANN; A = SELECT(semijoin: antibody IN X) ANN;", 2), ("X = SELECT(antibody == 'CTCF') ANN; A = SELECT(semijoin: antibody NOT IN X) ANN;", 2),
    ("X = SELECT() ANN; A = PROJECT(score; region_update: len AS right - left, left AS left + 1; metadata: cell; metadata_update: twice AS average * 2) X;", 4), ("X = SELECT() ANN; A = PROJECT(ALLBUT name) X;", 4),
    ("X = SELECT() ANN; A = EXTEND(n AS COUNT(), m AS MAX(score)) X;", 4), ("X = SELECT() ANN; A = ORDER(average DESC; meta_top: 1; region_order: score DESC; region_top: 1) X;", 1),
    ("X = SELECT() ANN; A = GROUP(antibody; meta_aggregates: n AS COUNTSAMP(); region_keys: name; region_aggregates: MAX(score)) X;", 4), ("X = SELECT() ANN; A = MERGE() X;", 4), ("X = SELECT() ANN; A = MERGE(groupby: EXACT(antibody)) X;", 4),
    ("X = SELECT() ANN; A = UNION() X X;", 8), ("X = SELECT() ANN; A = DIFFERENCE(exact: TRUE) X X;", 0), ("X = SELECT() ANN; A = MAP(AVG(score); joinby: cell; count_name: c) X X;", 4),
    ("X = SELECT() ANN; A = JOIN(DLE(-1); output: INT) X X;", 6), ("X = SELECT() ANN; A = JOIN(DISTANCE < 1000, MD(1), DOWN; output: BOTH; on_attributes: name) X X;", None), ("X = SELECT() ANN; A = COVER(1, ANY; aggregate: n AS COUNT()) X;", 3),
    ("X = SELECT() ANN; A = HISTOGRAM(ANY, (ALL + 3) / 2; groupby: antibody) X;", None), ("X = SELECT() ANN; A = COVER_FLAT(ALL / 2, ALL) X;", None), ("X = SELECT() ANN; A = SUMMIT(1, 5) X;", None),
]


@pytest.mark.parametrize("text, n", SCRIPTS)
def test_scripts(ann, text, n):
    target = text.rstrip("; ").rpartition(";")[2].split("=")[0].strip() if ";" in text.rstrip("; ") else text.split("=")[0].strip()
    target = "A" if "A =" in text else "a"
    out = run(ann, f"# a comment\n{text}\nMATERIALIZE {target} INTO out/x;")["out/x"]
    got = out.regions.count()
    out.meta.count()
    assert n is None or got == n


ERRORS = [
    ("A = SELECT() ANN", "end with"), ("A = SELECT() ANN;", "materialized"), ("A = SELECT() ANN; MATERIALIZE B;", "not defined"), ("A = SELECT() ANN; A = SELECT() ANN; MATERIALIZE A;", "twice"), ("A = FETCH() ANN; MATERIALIZE A;", "no operator FETCH"),
    ("A = SELECT() NONE; MATERIALIZE A;", "no dataset"), ("A = MERGE() NONE; MATERIALIZE A;", "not defined"), ("X = SELECT() ANN; A = MAP() X; MATERIALIZE A;", "2 inputs"), ("A = SELECT(color: 1) ANN; MATERIALIZE A;", "no option"),
    ("A = SELECT(region: nothing > 1) ANN; MATERIALIZE A;", "no attribute"), ("A = SELECT(region: name > 1) ANN; MATERIALIZE A;", "holds text"), ("A = SELECT(region: score == 'x') ANN; MATERIALIZE A;", "holds numbers"), ("A = SELECT(cell > 'x') ANN; MATERIALIZE A;", "compares numbers"),
    ("X = SELECT() ANN; A = MERGE(cell) X; MATERIALIZE A;", "unnamed"), ("X = SELECT() ANN; A = EXTEND() X; MATERIALIZE A;", "needs an aggregate"), ("X = SELECT() ANN; A = EXTEND(n AS SUM(name)) X; MATERIALIZE A;", "needs numbers"), ("X = SELECT() ANN; A = MAP(x AS SUM(score), x AS MIN(score)) X X; MATERIALIZE A;", "one name"),
    ("X = SELECT() ANN; A = COVER() X; MATERIALIZE A;", "two bounds"), ("X = SELECT() ANN; A = JOIN(DG(5)) X X; MATERIALIZE A;", "upper distance"), ("X = SELECT() ANN; A = JOIN(DLE(1), DLE(2), DLE(3), DLE(4), DLE(5)) X X; MATERIALIZE A;", "at most four"), ("X = SELECT() ANN; A = GROUP(; meta_aggregates: n AS COUNTSAMP()) X; MATERIALIZE A;", "metadata key"),
    ("A = SELECT((cell == 'x') ANN; MATERIALIZE A;", "end with"), ("X = SELECT() ANN; A = GROUP(region_keys: chr) X; MATERIALIZE A;", "not an attribute"), ("X = SELECT() ANN; A = PROJECT(metadata_update: a AS '') X; MATERIALIZE A;", "empty text"),
]


@pytest.mark.parametrize("text, said", ERRORS)
def test_errors(ann, text, said):
    with pytest.raises(ScriptError, match=said):
        run(ann, text)


def test_errors_of_several_statements_come_together():
    with pytest.raises(ScriptError, match="FETCH.*GRAB"):
        g.statements("A = FETCH() X; B = GRAB() Y;")


def test_parts():
    assert g.whole("a, EXACT(b.c), FULL(d)", g.riches) == [("default", "a"), ("exact", "b.c"), ("full", "d")]
    assert g.whole("SUM(x), n AS COUNT()", g.aggregates) == [Agg("SUM", "x", None), Agg("COUNT", None, "n")]
    assert g.whole("DL(5), DIST >= -3, UPSTREAM, MINDIST(2)", g.atoms) == [("DL", 5), ("DGE", -3), ("UP",), ("MD", 2)]
    assert g.whole("ALL / 2, (ALL + 1) / 3", g.bounds) == (("ALL/", 2), ("ALL+", 1, 3))
    assert g.whole("a == 1 OR b == 2 AND c == 3", g.meta_condition)[0] == "or"
    assert g.statements("A = SELECT(x == 'a;b)c') D; MATERIALIZE A INTO 'p/q';")[1].path == "p/q"


def test_functions_that_a_user_adds(spark):
    from pyspark.sql import functions as F

    from regionframe.functions import aggregates, expressions
    from regionframe.functions.aggregates import Agg
    from regionframe.lang.tokens import ScriptError
    from regionframe.model import Dataset

    aggregates.register("PRODUCT_OF", lambda x: F.product(x))
    aggregates.register("SHORTEST", lambda x: F.min_by(x, F.length(x)), takes="string", gives="string")
    expressions.register("POWER_OF", F.pow, ("double", "double"))
    rows = [(1, "c", 0, 9, "+", 2.0, "aa"), (1, "c", 0, 9, "+", 3.0, "b"), (1, "c", 20, 30, "+", 5.0, "ccc")]
    ds = Dataset.of(spark.createDataFrame(rows, "sample_id long, chrom string, left long, right long, strand string, x double, t string"), spark.createDataFrame([(1, "k", "2"), (1, "k", "4")], "sample_id long, attribute string, value string"), "D")
    run = lambda text: Script({"D": ds}).run("A = SELECT() D; " + text + " MATERIALIZE B INTO b;")["b"]
    grouped = run("B = GROUP(region_aggregates: p AS PRODUCT_OF(x), s AS SHORTEST(t)) A;")
    assert sorted(tuple(r)[2:] for r in grouped.regions.collect()) == [(0, 9, "+", 6.0, "b"), (20, 30, "+", 5.0, "ccc")]
    powers = run("B = PROJECT(region_update: y AS POWER_OF(x, 2) + 1) A;")
    assert sorted(r["y"] for r in powers.regions.collect()) == [5.0, 10.0, 26.0]
    assert ("p", "30") in {(r["attribute"], r["value"]) for r in run("B = EXTEND(p AS PRODUCT_OF(x)) A;").meta.collect()}
    mapped = run("B = MAP(p AS PRODUCT_OF(x)) A A;")
    assert sorted((r["left"], r["p"]) for r in mapped.regions.collect()) == [(0, 6.0), (0, 6.0), (20, 5.0)]
    meta = ds.group("k", meta_aggregates=[Agg("PRODUCT_OF", "k", "p")])
    assert ("p", "8") in {(r["attribute"], r["value"]) for r in meta.meta.collect()}
    for text in ("B = GROUP(region_aggregates: p AS PRODUCT_OF(t)) A;", "B = GROUP(region_aggregates: p AS NOTHING(x)) A;", "B = PROJECT(region_update: y AS POWER_OF(x)) A;"):
        with pytest.raises(ScriptError):
            run(text)
    with pytest.raises(ValueError):
        aggregates.register("SUM", F.sum)
