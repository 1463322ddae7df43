"""One query for each operator on the star-schema tables, with the same result in SQL.

Sample ids of results are hashes of the samples they come from, so queries show
these instead: ref_id and exp_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.functions import aggregates, expressions
from regionframe.functions.aggregates import Agg
from regionframe.lang.script import Script
from regionframe.model import Dataset, c
from regionframe.sources.readers import Parser, lines, pairs, parser_of
from regionframe.sources.schema import Schema
from regionframe.sources.writers import gtf_lines, profile, tab_lines
from regionframe.testdata import events, items

QUERIES = {}
ORACLES = {}
BIN = 1000

BASE = """
WITH RECURSIVE li AS (
  SELECT CAST(l_suppkey % 10 AS BIGINT) AS sid, 'chr' || l_linenumber AS chrom, CAST(l_partkey * 20 AS BIGINT) AS l, CAST(l_partkey * 20 + CAST(l_quantity AS BIGINT) AS BIGINT) AS r,
    CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '*' END AS s, l_extendedprice AS score, l_discount AS discount, l_tax AS tax, l_linestatus AS linestatus
  FROM lineitem
), ev AS (
  SELECT CAST(user_id % 10 AS BIGINT) AS sid, event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS l, CAST(floor(epoch(ts)) AS BIGINT) + 1 + CAST(floor(value * 50) AS BIGINT) AS r, '*' AS s, value FROM events
), ids AS (SELECT CAST(unnest(range(10)) AS BIGINT) AS sid), meta AS (
  SELECT sid, 'group' AS attribute, 'g' || (sid % 3) AS value FROM ids
  UNION SELECT sid, 'batch', 'b' || (sid % 2) FROM ids UNION SELECT sid, 'batch', 'b' || (sid % 5) FROM ids
  UNION SELECT sid, 'weight', CAST(CAST(sid * 1.5 AS DOUBLE) AS VARCHAR) FROM ids UNION SELECT sid, 'odd', 'yes' FROM ids WHERE sid % 2 = 1
  UNION SELECT CAST(s_suppkey % 10 AS BIGINT), 'nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
), ev_e AS (SELECT * FROM li WHERE sid % 2 = 0), od AS (SELECT * FROM li WHERE sid % 2 = 1),
me AS (SELECT * FROM meta WHERE sid % 2 = 0), mo AS (SELECT * FROM meta WHERE sid % 2 = 1)
"""
COORD = 'sid AS sample_id, chrom, l AS "left", r AS "right", s AS strand'


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = BASE + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c(n), digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def lineage(df: DataFrame, spark: SparkSession) -> DataFrame:
    """sample_id as ref_id and exp_id."""
    ids = spark.range(10)
    pairs = ids.select(F.col("id").alias("ref_id")).crossJoin(ids.select(F.col("id").alias("exp_id"))).withColumn("sample_id", F.xxhash64("ref_id", "exp_id"))
    return df.join(F.broadcast(pairs), "sample_id").drop("sample_id")


def left_of(df: DataFrame, spark: SparkSession) -> DataFrame:
    ids = spark.range(10).select(F.col("id").alias("ref_id"), F.xxhash64("id").alias("sample_id"))
    return df.join(F.broadcast(ids), "sample_id").drop("sample_id")


def eo(spark: SparkSession, d: str) -> tuple[Dataset, Dataset]:
    return items(spark, d, 0), items(spark, d, 1)


# SELECT

_ALL = f"SELECT {COORD}, score, discount, tax, linestatus FROM li"


def _meta_where(having: str) -> str:
    return f", k AS (SELECT sid FROM meta GROUP BY sid HAVING {having}) {_ALL} WHERE sid IN (SELECT sid FROM k)"


def _some(cond: str) -> str:
    return f"coalesce(bool_or({cond}), false)"


_META = {
    "select_meta_text": (("cmp", "group", "==", "G1"), _some("attribute = 'group' AND lower(value) = 'g1'")),
    "select_meta_any": (("cmp", "odd", "==", "*"), _some("attribute = 'odd'")),
    "select_meta_number": (("cmp", "weight", "==", 3), _some("attribute = 'weight' AND try_cast(value AS DOUBLE) = 3")),
    "select_meta_not_equal": (("cmp", "batch", "!=", "b0"), _some("attribute = 'batch' AND lower(value) <> 'b0'")),
    "select_meta_compare": (("and", ("cmp", "weight", ">", 2), ("cmp", "weight", "<=", 9)), f"{_some("attribute = 'weight' AND try_cast(value AS DOUBLE) > 2")} AND {_some("attribute = 'weight' AND try_cast(value AS DOUBLE) <= 9")}"),
    "select_meta_logic": (("or", ("not", ("cmp", "group", "==", "g0")), ("cmp", "odd", "==", "yes")), f"NOT {_some("attribute = 'group' AND lower(value) = 'g0'")} OR {_some("attribute = 'odd' AND lower(value) = 'yes'")}"),
    "select_meta_has": (("has", "odd"), _some("attribute = 'odd'")),
    "select_meta_lacks": (("lacks", "odd"), f"NOT {_some("attribute = 'odd'")}"),
}
for _name, (_p, _having) in _META.items():
    query(_name, _meta_where(_having))(lambda spark, d, p=_p: items(spark, d).select(p).regions)

_REGION = {
    "select_chrom_strand": (("and", ("cmp", ("coord", "chr"), "==", "chr2"), ("cmp", ("coord", "strand"), "==", "+")), "chrom = 'chr2' AND s = '+'"),
    "select_left_right": (("or", ("cmp", ("coord", "left"), "<", 500), ("cmp", ("coord", "right"), ">=", 3000)), "l < 500 OR r >= 3000"),
    "select_start_stop": (("and", ("cmp", ("coord", "start"), ">", 1000), ("not", ("cmp", ("coord", "stop"), ">", 2000))), "CASE WHEN s = '-' THEN r ELSE l END > 1000 AND NOT CASE WHEN s = '-' THEN l ELSE r END > 2000"),
    "select_attribute": (("and", ("cmp", ("field", "discount"), ">=", 0.05), ("cmp", ("field", "linestatus"), "==", "O")), "discount >= 0.05 AND linestatus = 'O'"),
    "select_position": (("cmp", ("field", "$0"), ">", 50000), "score > 50000"),
}
for _name, (_p, _where) in _REGION.items():
    query(_name, f"{_ALL} WHERE {_where}")(lambda spark, d, p=_p: items(spark, d).select(region=p).regions)


@query("select_region_meta", f"{_ALL} JOIN (SELECT sid AS k, min(value) AS w FROM meta WHERE attribute = 'weight' GROUP BY sid) ON sid = k WHERE discount * 100 > try_cast(w AS DOUBLE)")
def select_region_meta(spark, d):
    ds = items(spark, d)
    scaled = ds.with_regions(ds.regions.withColumn("percent", c("discount") * 100))
    return scaled.select(region=("cmp", ("field", "percent"), ">", ("meta", "weight"))).project(["percent"], all_but=True).regions


@query("select_purge", f", k AS (SELECT DISTINCT sid FROM li WHERE score > 99000 AND sid IN (SELECT sid FROM meta WHERE attribute = 'group' AND value = 'g1')) SELECT sid AS sample_id, attribute, value FROM meta WHERE sid IN (SELECT sid FROM k)")
def select_purge(spark, d):
    return items(spark, d).select(("cmp", "group", "==", "g1"), ("cmp", ("field", "score"), ">", 99000)).meta


@query("semijoin_in", f"{_ALL} WHERE sid IN (SELECT x.sid FROM (SELECT * FROM meta WHERE attribute = 'batch') x JOIN (SELECT * FROM mo WHERE attribute = 'batch' AND sid < 4) y ON x.value = y.value JOIN (SELECT * FROM meta WHERE attribute = 'group') u ON u.sid = x.sid JOIN (SELECT * FROM mo WHERE attribute = 'group') v ON v.sid = y.sid AND u.value = v.value)")
def semijoin_in(spark, d):
    other = items(spark, d, 1)
    other = other.with_meta(other.meta.filter("sample_id < 4"))
    return items(spark, d).select(semijoin=(["batch", "group"], other, False)).regions


@query("semijoin_not_in", f"{_ALL} WHERE sid IN (SELECT sid FROM meta WHERE attribute = 'group' AND value NOT IN (SELECT value FROM meta WHERE attribute = 'group' AND sid IN (1, 4)))")
def semijoin_not_in(spark, d):
    other = items(spark, d)
    return items(spark, d).select(semijoin=(["group"], other.with_meta(other.meta.filter("sample_id IN (1, 4)")), True)).regions


# PROJECT


@query("project_keep", f"SELECT {COORD}, score, linestatus FROM li")
def project_keep(spark, d):
    return items(spark, d).project(["linestatus", "$0"]).regions


@query("project_all_but", f"SELECT {COORD}, score, linestatus FROM li")
def project_all_but(spark, d):
    return items(spark, d).project(["discount", "t?x"], all_but=True).regions


@query("project_nothing", f"SELECT {COORD} FROM li")
def project_nothing(spark, d):
    return items(spark, d).project(()).regions


@query("project_update", f"SELECT {COORD}, score * (1 - discount) / (tax + 1) AS score, sqrt(score) - -discount AS root, CASE WHEN tax = 0 THEN NULL ELSE discount / tax END AS ratio, 'x' AS tag, CAST(NULL AS DOUBLE) AS none FROM li")
def project_update(spark, d):
    f = lambda n: ("field", n)
    return items(spark, d).project(["score"], update=[
        ("score", ("/", ("*", f("score"), ("-", ("num", 1), f("discount"))), ("+", f("tax"), ("num", 1)))), ("root", ("-", ("sqrt", f("score")), ("neg", f("discount")))),
        ("ratio", ("/", f("discount"), f("tax"))), ("tag", ("str", "x")), ("none", ("null", "DOUBLE")),
    ]).regions


@query("project_coordinates", """, x AS (SELECT sid, chrom, s, CASE WHEN s = '-' THEN l ELSE l - 100 END AS l, CASE WHEN s = '-' THEN r + 100 ELSE r END AS r, score FROM li)
SELECT sid AS sample_id, chrom, greatest(l, 0) AS "left", r AS "right", s AS strand, score FROM x WHERE l < r""")
def project_coordinates(spark, d):
    # on the - strand the subtraction turns into an addition, away from the region's start
    return items(spark, d).project(["score"], update=[("start", ("-", ("coord", "start"), ("num", 100)))]).regions


@query("project_invalid", f'SELECT sid AS sample_id, chrom, l + 20 AS "left", r AS "right", s AS strand, score FROM li WHERE l + 20 < r')
def project_invalid(spark, d):
    return items(spark, d).project(["score"], update=[("left", ("+", ("coord", "left"), ("num", 20)))]).regions


@query("project_meta_value", f"SELECT {COORD}, score * try_cast(w AS DOUBLE) AS weighted, g AS grp FROM li LEFT JOIN (SELECT sid AS k, min(CASE WHEN attribute = 'weight' THEN value END) AS w, min(CASE WHEN attribute = 'group' THEN value END) AS g FROM meta GROUP BY sid) ON sid = k")
def project_meta_value(spark, d):
    out = items(spark, d).project((), update=[("weighted", ("*", ("field", "score"), ("meta", "weight", "DOUBLE"))), ("grp", ("meta", "group", "STRING"))])
    return out.regions


@query("project_metadata", "SELECT sid AS sample_id, attribute, value FROM meta WHERE attribute NOT IN ('nation', 'batch')")
def project_metadata(spark, d):
    return items(spark, d).project(meta_keep=["nation", "batch"], meta_all_but=True).meta


@query("project_meta_update", "SELECT sid AS sample_id, attribute, value FROM meta WHERE attribute <> 'weight' UNION ALL SELECT sid, 'weight', CASE WHEN w * 2 + 1 = floor(w * 2 + 1) THEN CAST(CAST(w * 2 + 1 AS BIGINT) AS VARCHAR) ELSE CAST(w * 2 + 1 AS VARCHAR) END FROM (SELECT sid, min(try_cast(value AS DOUBLE)) AS w FROM meta WHERE attribute = 'weight' GROUP BY sid) UNION ALL SELECT sid, 'label', 'fixed' FROM ids")
def project_meta_update(spark, d):
    return items(spark, d).project(meta_update=[("weight", ("+", ("*", ("field", "weight"), ("num", 2)), ("num", 1))), ("label", ("str", "fixed"))]).meta


# EXTEND, GROUP, ORDER

_Q = "list_sort(list(discount)) AS v, count(*) AS n"


@query("extend", """, a AS (SELECT sid, count(*) AS n, min(score) AS lo, max(score) AS hi, list_sort(list(discount)) AS v, string_agg(DISTINCT linestatus, ',' ORDER BY linestatus) AS bag, avg(CAST(discount AS DECIMAL(18, 4))) AS av, stddev_samp(tax) AS sd FROM li GROUP BY sid),
q AS (SELECT *, n // 2 AS h, (n // 2) // 2 AS d1, n // 2 + (n // 2) // 2 AS d3 FROM a)
SELECT sid AS sample_id, CAST(n AS DOUBLE) AS n, lo, hi, v[(n - 1) // 2 + 1] AS med, CASE WHEN n % 2 = 0 AND d1 > 0 THEN (v[d1 + 1] + v[d1]) / 2 ELSE v[d1 + 1] END AS q1, CASE WHEN n % 2 = 0 THEN (v[d3 + 1] + v[d3]) / 2 ELSE v[d3 + 1] END AS q3, bag, round(CAST(av AS DOUBLE), 4) AS av, round(sd, 4) AS sd FROM q""")
def extend(spark, d):
    aggs = [Agg("COUNT", None, "n"), Agg("MIN", "score", "lo"), Agg("MAX", "score", "hi"), Agg("MEDIAN", "discount", "med"), Agg("Q1", "discount", "q1"), Agg("Q3", "discount", "q3"), Agg("BAGD", "linestatus", "bag"), Agg("AVG", "discount", "av"), Agg("STD", "tax", "sd")]
    new = items(spark, d).extend(aggs).meta.filter(F.col("attribute").isin([a.name for a in aggs]))
    pick = lambda n: F.max(F.when(F.col("attribute") == n, F.col("value")))
    out = new.groupBy("sample_id").agg(*[(pick(a.name) if a.name == "bag" else pick(a.name).cast("double")).alias(a.name) for a in aggs])
    return out.withColumn("av", F.round("av", 4)).withColumn("sd", F.round("sd", 4))


@query("group_meta", """, k AS (SELECT sid, min(value) AS v FROM meta WHERE attribute = 'group' AND sid <> 4 GROUP BY sid), g AS (SELECT ids.sid, coalesce(dense, 0) AS n FROM ids LEFT JOIN (SELECT sid, dense_rank() OVER (ORDER BY v) AS dense FROM k) x ON ids.sid = x.sid)
SELECT g.sid AS sample_id, 'cluster' AS attribute, CAST(n AS VARCHAR) AS value FROM g UNION ALL
SELECT g.sid, 'samples', CAST(m AS VARCHAR) FROM g JOIN (SELECT n, count(*) AS m FROM g GROUP BY n) t ON g.n = t.n UNION ALL
SELECT g.sid, 'batches', b FROM g JOIN (SELECT n, string_agg(DISTINCT value, ',' ORDER BY value) AS b FROM g JOIN meta ON g.sid = meta.sid AND attribute = 'batch' GROUP BY n) t ON g.n = t.n""")
def group_meta(spark, d):
    ds = items(spark, d)
    ds = ds.with_meta(ds.meta.filter("NOT (sample_id = 4 AND attribute = 'group')"))
    out = ds.group("group", [Agg("COUNTSAMP", None, "samples"), Agg("BAGD", "batch", "batches")], "cluster").meta
    return out.filter(F.col("attribute").isin("cluster", "samples", "batches"))


@query("group_regions", f"SELECT {COORD}, linestatus, CAST(count(*) AS DOUBLE) AS n, max(score) AS top, round(CAST(sum(CAST(tax AS DECIMAL(18, 4))) AS DOUBLE), 2) AS taxes FROM li GROUP BY ALL")
def group_regions(spark, d):
    return rounded(items(spark, d).group(region_keys=["linestatus"], region_aggregates=[Agg("COUNT", None, "n"), Agg("MAX", "score", "top"), Agg("SUM", "tax", "taxes")]).regions)


@query("group_distinct", f"SELECT DISTINCT {COORD} FROM li")
def group_distinct(spark, d):
    return items(spark, d).group().regions


@query("order_meta", """, o AS (SELECT sid, row_number() OVER (ORDER BY v DESC, sid) AS k FROM (SELECT sid, max(try_cast(value AS DOUBLE)) AS v FROM meta WHERE attribute = 'weight' GROUP BY sid))
SELECT sid AS sample_id, '_order' AS attribute, CAST(k AS VARCHAR) AS value FROM o WHERE k <= 4 UNION ALL SELECT sid, attribute, value FROM meta WHERE sid IN (SELECT sid FROM o WHERE k <= 4)""")
def order_meta(spark, d):
    ds = items(spark, d)
    # a single value for each sample, so that text and numbers order alike
    return ds.with_meta(ds.meta).order([("weight", False)], ("top", 4)).meta


@query("order_meta_groups", """, v AS (SELECT sid, min(CASE WHEN attribute = 'group' THEN value END) AS g, max(CASE WHEN attribute = 'nation' THEN value END) AS w FROM meta GROUP BY sid),
o AS (SELECT sid, row_number() OVER (PARTITION BY g ORDER BY w DESC NULLS LAST, sid) AS k FROM v) SELECT sid AS sample_id, CAST(k AS BIGINT) AS k FROM o WHERE k <= 2""")
def order_meta_groups(spark, d):
    out = items(spark, d).order([("group", True), ("nation", False)], ("topg", 2)).meta
    return out.filter("attribute = '_order'").select("sample_id", F.col("value").cast("long").alias("k"))


_O = ", o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {key}, chrom, l, r, s, score, discount, tax, linestatus) AS k, count(*) OVER (PARTITION BY {part}) AS n FROM li) SELECT sid AS sample_id, chrom, l AS \"left\", r AS \"right\", s AS strand, score, discount, tax, linestatus, CAST(k AS DOUBLE) AS \"order\" FROM o WHERE {where}"


@query("order_regions_top", _O.format(part="sid", key="score DESC", where="k <= 20"))
def order_regions_top(spark, d):
    return items(spark, d).order(region_keys=[("score", False)], region_top=("top", 20)).regions


@query("order_regions_groups", _O.format(part="sid, linestatus", key="tax DESC", where="k <= 3"))
def order_regions_groups(spark, d):
    return items(spark, d).order(region_keys=[("linestatus", True), ("tax", False)], region_top=("topg", 3)).regions


@query("order_regions_percent", _O.format(part="sid", key="score", where="k <= floor(n * 5 / 100)"))
def order_regions_percent(spark, d):
    return items(spark, d).order(region_keys=[("score", True)], region_top=("topp", 5)).regions


# MERGE, UNION, DIFFERENCE


@query("merge", "SELECT CAST(1 AS BIGINT) AS sample_id, attribute, value FROM (SELECT DISTINCT attribute, value FROM meta)")
def merge(spark, d):
    return items(spark, d).merge().meta


@query("merge_groups", "SELECT v AS grp, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(score AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total FROM li JOIN (SELECT sid AS k, value AS v FROM meta WHERE attribute = 'group') ON sid = k GROUP BY v")
def merge_groups(spark, d):
    out = items(spark, d).merge(["group"])
    of = out.meta.filter("attribute = 'group'").select("sample_id", F.col("value").alias("grp"))
    return out.regions.join(of, "sample_id").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c("score").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("union_regions", """SELECT tag, sid AS ref_id, chrom, l AS "left", r AS "right", s AS strand, score, v AS discount FROM (SELECT 0 AS tag, sid, chrom, l, r, s, score, discount AS v FROM ev_e UNION ALL SELECT 1, sid, chrom, l, r, s, score, CAST(NULL AS DOUBLE) FROM od)""")
def union_regions(spark, d):
    x, y = eo(spark, d)
    out = x.project(["score", "discount"]).union(y.project(["score", "linestatus"])).regions
    ids = spark.range(10).withColumn("tag", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.xxhash64("tag", "id").alias("sample_id"), F.col("id").alias("ref_id"), "tag")
    return out.join(F.broadcast(ids), "sample_id").drop("sample_id")


@query("union_meta", "SELECT attribute, value FROM meta UNION ALL SELECT '_provenance', CASE sid % 2 WHEN 0 THEN 'E' ELSE 'O' END FROM ids")
def union_meta(spark, d):
    x, y = eo(spark, d)
    return x.union(y).meta.select("attribute", "value")


_LAP = "a.chrom = b.chrom AND a.l < b.r AND b.l < a.r AND (a.s = '*' OR b.s = '*' OR a.s = b.s)"
_A = 'a.sid AS ref_id, a.chrom, a.l AS "left", a.r AS "right", a.s AS strand, a.score, a.discount, a.tax, a.linestatus'


@query("difference", f"SELECT DISTINCT {_A} FROM ev_e a WHERE NOT EXISTS (SELECT 1 FROM od b WHERE {_LAP})")
def difference(spark, d):
    x, y = eo(spark, d)
    return left_of(x.difference(y, bin_size=BIN).regions, spark)


@query("difference_exact", f"SELECT DISTINCT {_A} FROM ev_e a WHERE NOT EXISTS (SELECT 1 FROM od b WHERE a.chrom = b.chrom AND a.l = b.l AND a.r = b.r AND (a.s = '*' OR b.s = '*' OR a.s = b.s))")
def difference_exact(spark, d):
    x, y = eo(spark, d)
    return left_of(x.difference(y, exact=True).regions, spark)


_PAIRS = ", pr AS (SELECT DISTINCT x.sid AS i, y.sid AS j FROM me x JOIN mo y ON x.attribute = 'group' AND y.attribute = 'group' AND x.value = y.value)"


@query("difference_joinby", f"{_PAIRS} SELECT DISTINCT {_A} FROM ev_e a WHERE a.sid IN (SELECT i FROM pr) AND NOT EXISTS (SELECT 1 FROM od b, pr WHERE pr.i = a.sid AND pr.j = b.sid AND {_LAP})")
def difference_joinby(spark, d):
    x, y = eo(spark, d)
    return left_of(x.difference(y, joinby=["group"], bin_size=BIN).regions, spark)


# functions that a user adds

aggregates.register("SPREAD", lambda x: F.max(x) - F.min(x))
expressions.register("PART_OF", lambda a, b: F.try_divide(a, a + b), ("double", "double"))


@query("custom_aggregate", f"SELECT {COORD}, linestatus, round(max(score) - min(score), 2) AS spread FROM li GROUP BY sid, chrom, l, r, s, linestatus")
def custom_aggregate(spark, d):
    return rounded(items(spark, d).group(region_keys=["linestatus"], region_aggregates=[Agg("SPREAD", "score", "spread")]).regions)


@query("custom_function", f"SELECT {COORD}, round(discount / (discount + tax), 6) AS part FROM li")
def custom_function(spark, d):
    text = "A = SELECT() E; R = PROJECT(region_update: part AS PART_OF(discount, tax)) A; MATERIALIZE R INTO r;"
    return rounded(Script({"E": items(spark, d)}).run(text)["r"].project(["part"]).regions, 6)


# MAP


@query("map_count", f""", x AS (SELECT DISTINCT sid, chrom, l, r, s, score, count(*) OVER (PARTITION BY sid, chrom, l, r, s, score) AS m FROM ev_e),
k AS (SELECT a.sid, a.chrom, a.l, a.r, a.s, a.score, b.sid AS j, count(*) * any_value(a.m) AS n FROM x a JOIN od b ON {_LAP} GROUP BY ALL)
SELECT x.sid AS ref_id, e.j AS exp_id, x.chrom, x.l AS "left", x.r AS "right", x.s AS strand, x.score, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM x CROSS JOIN (SELECT DISTINCT sid AS j FROM mo) e LEFT JOIN k ON k.sid = x.sid AND k.chrom = x.chrom AND k.l = x.l AND k.r = x.r AND k.s = x.s AND k.score = x.score AND k.j = e.j""")
def map_count(spark, d):
    x, y = eo(spark, d)
    return lineage(x.project(["score"]).map(y, count_name="n", bin_size=BIN).regions, spark)


@query("map_aggregates", f"""{_PAIRS}, x AS (SELECT DISTINCT sid, chrom, l, r, s FROM ev_e),
k AS (SELECT a.sid, a.chrom, a.l, a.r, a.s, b.sid AS j, count(*) AS n, round(CAST(sum(CAST(b.score AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total, min(b.tax) AS lo, max(b.tax) AS hi, quantile_disc(b.discount, 0.5) AS med, string_agg(DISTINCT b.linestatus, ',' ORDER BY b.linestatus) AS bag FROM (SELECT * FROM ev_e) a JOIN od b ON {_LAP} GROUP BY ALL)
SELECT x.sid AS ref_id, pr.j AS exp_id, x.chrom, x.l AS "left", x.r AS "right", x.s AS strand, CAST(coalesce(n, 0) AS DOUBLE) AS n, total, lo, hi, med, coalesce(bag, '.') AS bag FROM x JOIN pr ON pr.i = x.sid LEFT JOIN k ON k.sid = x.sid AND k.chrom = x.chrom AND k.l = x.l AND k.r = x.r AND k.s = x.s AND k.j = pr.j""")
def map_aggregates(spark, d):
    x, y = eo(spark, d)
    aggs = [Agg("SUM", "score", "total"), Agg("MIN", "tax", "lo"), Agg("MAX", "tax", "hi"), Agg("MEDIAN", "discount", "med"), Agg("BAGD", "linestatus", "bag")]
    return rounded(lineage(x.project(()).map(y, aggs, ["group"], "n", bin_size=BIN).regions, spark))


@query("map_one_partner", f""", x AS (SELECT DISTINCT sid, chrom, l, r, s FROM ev_e), k AS (SELECT a.sid, a.chrom, a.l, a.r, a.s, count(*) AS n, max(b.tax) AS hi FROM ev_e a JOIN od b ON b.sid = a.sid + 1 AND {_LAP} GROUP BY ALL)
SELECT x.sid AS ref_id, x.sid + 1 AS exp_id, x.chrom, x.l AS "left", x.r AS "right", x.s AS strand, CAST(coalesce(n, 0) AS DOUBLE) AS n, hi FROM x LEFT JOIN k ON k.sid = x.sid AND k.chrom = x.chrom AND k.l = x.l AND k.r = x.r AND k.s = x.s""")
def map_one_partner(spark, d):
    one = lambda ds: ds.with_meta(ds.meta.select("sample_id", F.lit("couple").alias("attribute"), F.expr("CAST(sample_id DIV 2 AS STRING)").alias("value")).distinct())
    x, y = map(one, eo(spark, d))
    return lineage(x.project(()).map(y, [Agg("MAX", "tax", "hi")], ["couple"], "n", bin_size=BIN).regions, spark)


@query("map_bag", f""", k AS (SELECT a.sid, a.chrom, a.l, a.r, a.s, b.sid AS j, string_agg(b.linestatus, ',' ORDER BY b.linestatus) AS bag, round(avg(b.discount), 4) AS mean FROM ev_e a JOIN od b ON {_LAP} GROUP BY ALL)
SELECT sid AS ref_id, j AS exp_id, chrom, l AS "left", r AS "right", s AS strand, bag, mean FROM k""")
def map_bag(spark, d):
    x, y = eo(spark, d)
    out = x.project(()).map(y, [Agg("BAG", "linestatus", "bag"), Agg("AVG", "discount", "mean")], count_name="n", bin_size=BIN)
    return rounded(lineage(out.select(region=("cmp", ("field", "n"), ">", 0)).project(["bag", "mean"]).regions, spark), 4)


@query("map_meta", f"{_PAIRS} SELECT i AS ref_id, j AS exp_id, 'E.' || attribute AS attribute, value FROM pr JOIN me ON me.sid = i UNION ALL SELECT i, j, 'O.' || attribute, value FROM pr JOIN mo ON mo.sid = j")
def map_meta(spark, d):
    x, y = eo(spark, d)
    return lineage(x.map(y, joinby=["group"]).meta, spark)


# JOIN

_DIST = "CASE WHEN a.r < b.l OR b.r < a.l THEN least(abs(a.l - b.r), abs(b.l - a.r)) ELSE -least(abs(a.l - b.r), abs(b.l - a.r)) END"
_STR = "a.chrom = b.chrom AND (a.s = '*' OR b.s = '*' OR a.s = b.s)"


def _join(where: str, select: str, pairs: str = "", on: str = "") -> str:
    return f"{pairs}, j AS (SELECT a.sid AS i, b.sid AS k, a.chrom, a.l AS al, a.r AS ar, a.s AS sa, a.score AS ascore, a.linestatus AS als, b.l AS bl, b.r AS br, b.s AS sb, b.score AS bscore, b.linestatus AS bls, {_DIST} AS dist FROM ev_e a JOIN od b ON {_STR} {on} AND a.l - 300 < b.r AND b.l - 300 < a.r) SELECT i AS ref_id, k AS exp_id, {select} FROM j WHERE {where}"


_BOTH_SCORES = 'ascore AS "E.score", bscore AS "O.score"'


def scores(spark, d):
    x, y = eo(spark, d)
    return x.project(["score"]), y.project(["score"])


@query("join_distance_left", _join("dist <= 30", f'chrom, al AS "left", ar AS "right", sa AS strand, {_BOTH_SCORES}'))
def join_distance_left(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("DLE", 30)], output="LEFT", bin_size=BIN).regions, spark)


@query("join_distance_contig", _join("dist < 40 AND dist > 5", f'chrom, least(al, bl) AS "left", greatest(ar, br) AS "right", sa AS strand, {_BOTH_SCORES}'))
def join_distance_contig(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("DL", 40), ("DG", 5)], output="CAT", bin_size=BIN).regions, spark)


@query("join_intersection", _join("dist < 0 AND al < br AND bl < ar", f"chrom, greatest(al, bl) AS \"left\", least(ar, br) AS \"right\", CASE WHEN sa = sb THEN sa ELSE '*' END AS strand, {_BOTH_SCORES}"))
def join_intersection(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("DLE", -1)], output="INT", bin_size=BIN).regions, spark)


@query("join_upstream", _join("dist <= 50 AND dist >= 2 AND CASE WHEN sa = '-' THEN bl >= ar ELSE br <= al END", f'chrom, bl AS "left", br AS "right", sb AS strand, {_BOTH_SCORES}'))
def join_upstream(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("DLE", 50), ("DGE", 2), ("UP",)], output="RIGHT", bin_size=BIN).regions, spark)


@query("join_downstream", _join("dist <= 20 AND CASE WHEN sa = '-' THEN br <= al ELSE bl >= ar END", f'chrom, al AS "left", ar AS "right", sa AS strand, ascore AS "E.score", chrom AS "O.chr", CAST(bl AS DOUBLE) AS "O.start", CAST(br AS DOUBLE) AS "O.stop", sb AS "O.strand", bscore AS "O.score"'))
def join_downstream(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("DLE", 20), ("DOWN",)], output="BOTH", bin_size=BIN).regions, spark)


_NEAR = ", r AS (SELECT *, rank() OVER (PARTITION BY i, k, chrom, al, ar, sa, ascore ORDER BY dist) AS rk FROM j WHERE {first}) SELECT i AS ref_id, k AS exp_id, chrom, bl AS \"left\", br AS \"right\", sb AS strand, ascore AS \"E.score\", bscore AS \"O.score\" FROM r WHERE rk <= {n} AND {then}"


def _nearest(first: str, n: int, then: str) -> str:
    return _join("true", "1").rpartition(" SELECT i AS ref_id")[0] + _NEAR.format(first=first, n=n, then=then)


@query("join_nearest", _nearest("dist <= 200", 1, "true"))
def join_nearest(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("MD", 1)], output="RIGHT", max_distance=200, bin_size=BIN).regions, spark)


@query("join_nearest_filtered", _nearest("dist <= 200 AND dist > 3", 2, "CASE WHEN sa = '-' THEN bl >= ar ELSE br <= al END"))
def join_nearest_filtered(spark, d):
    x, y = scores(spark, d)
    out = x.join(y, [("DLE", 200), ("DG", 3), ("MD", 2), ("UP",)], output="RIGHT", bin_size=BIN)
    return lineage(out.regions, spark)


@query("join_distinct", _join("dist <= 10", 'chrom, al AS "left", ar AS "right", sa AS strand, ascore AS score').replace("SELECT i AS ref_id", "SELECT DISTINCT i AS ref_id"))
def join_distinct(spark, d):
    x, y = scores(spark, d)
    return lineage(x.join(y, [("DLE", 10)], output="LEFT_DISTINCT", bin_size=BIN).regions, spark)


@query("join_attributes", _join("dist <= 20", 'chrom, al AS "left", ar AS "right", sa AS strand, als AS "E.linestatus", bls AS "O.linestatus"', _PAIRS, "AND a.linestatus = b.linestatus").replace("FROM j WHERE", "FROM j JOIN pr ON pr.i = j.i AND pr.j = j.k WHERE").replace("SELECT i AS ref_id, k AS exp_id", "SELECT j.i AS ref_id, j.k AS exp_id"))
def join_attributes(spark, d):
    x, y = eo(spark, d)
    return lineage(x.project(["linestatus"]).join(y.project(["linestatus"]), [("DLE", 20)], ["group"], ["linestatus"], "LEFT", bin_size=BIN).regions, spark)


@query("join_attributes_only", f"SELECT a.sid AS ref_id, b.sid AS exp_id, a.chrom, a.l AS \"left\", a.r AS \"right\", a.s AS strand, a.discount AS \"E.discount\", a.tax AS \"E.tax\", b.discount AS \"O.discount\", b.tax AS \"O.tax\" FROM ev_e a JOIN od b ON {_STR} AND a.discount = b.discount AND a.tax = b.tax WHERE a.l < 200")
def join_attributes_only(spark, d):
    x, y = eo(spark, d)
    x = x.select(region=("cmp", ("coord", "left"), "<", 200)).project(["discount", "tax"])
    return lineage(x.join(y.project(["discount", "tax"]), on_attributes=["discount", "tax"], output="LEFT").regions, spark)


# COVER


def _sweep(source: str, group: str) -> str:
    return f""", src AS ({source}), gs AS ({group}), rg AS (SELECT g, chrom, CASE WHEN (SELECT bool_or(s = '*') FROM src) THEN '*' ELSE s END AS s, l, r, v FROM src JOIN gs ON src.sid = gs.sid),
e AS (SELECT g, chrom, s, p, sum(dl) AS dl FROM (SELECT g, chrom, s, l AS p, 1 AS dl FROM rg UNION ALL SELECT g, chrom, s, r, -1 FROM rg) GROUP BY ALL HAVING sum(dl) <> 0),
w AS (SELECT g, chrom, s, p, sum(dl) OVER z AS d, lead(p) OVER z AS q, dl, coalesce(lead(dl) OVER z, 0) AS nd FROM e WINDOW z AS (PARTITION BY g, chrom, s ORDER BY p)),
t AS (SELECT g, chrom, s, p, q, d, d - dl AS b, d + nd AS n FROM w WHERE q IS NOT NULL)"""


def _within(x: str, lo: str, hi: str) -> str:
    return f"({x} > 0 AND {x} BETWEEN {lo} AND {hi})"


def _islands(lo: str, hi: str) -> str:
    return f""", on1 AS (SELECT *, CASE WHEN {_within("b", lo, hi)} THEN 0 ELSE 1 END AS fresh FROM t WHERE {_within("d", lo, hi)}),
on2 AS (SELECT *, sum(fresh) OVER (PARTITION BY g, chrom, s ORDER BY p) AS run FROM on1), f AS (SELECT g, chrom, s, min(p) AS l, max(q) AS r, max(d) AS top FROM on2 GROUP BY g, chrom, s, run)"""


def _contributors(flat: bool = False, aggs: str = "") -> str:
    lo, hi = ("mn", "mx") if flat else ("l", "r")
    inner = ", count(*) AS cn, round(max(rg.v), 4) AS cv" if aggs else ""
    return f""", h AS (SELECT f.g, f.chrom, f.s, f.l, f.r, f.top, min(rg.l) AS mn, max(rg.r) AS mx, greatest(min(rg.r) - max(rg.l), 0) AS cm{inner} FROM f JOIN rg ON f.g = rg.g AND f.chrom = rg.chrom AND f.s = rg.s AND f.l < rg.r AND rg.l < f.r GROUP BY ALL)
SELECT g AS grp, chrom, {lo} AS "left", {hi} AS "right", s AS strand, CAST(top AS DOUBLE) AS "AccIndex", round((r - l) / CAST(mx - mn AS DOUBLE), 4) AS "JaccardIntersect", round(cm / CAST(mx - mn AS DOUBLE), 4) AS "JaccardResult"{aggs} FROM h"""


_EV, _ONE = "SELECT sid, chrom, l, r, s, value AS v FROM ev", "SELECT sid, 'all' AS g FROM ids"
_PLUS_MINUS, _BY = "SELECT sid, chrom, l, r, s, score AS v FROM li WHERE s <> '*'", "SELECT sid, value AS g FROM meta WHERE attribute = 'group'"


def _named_groups(out: Dataset, ds: Dataset, attribute: str | None) -> DataFrame:
    if attribute is None:
        named = out.regions.withColumn("grp", F.lit("all"))
    else:
        named = out.regions.join(out.meta.filter(F.col("attribute") == attribute).select("sample_id", F.col("value").alias("grp")), "sample_id")
    return rounded(named.drop("sample_id"), 4)


@query("cover", _sweep(_EV, _ONE) + _islands("2", "9223372036854775807") + _contributors())
def cover(spark, d):
    ds = events(spark, d)
    return _named_groups(ds.cover(2, "ANY", bin_size=BIN, part=5000), ds, None)


@query("flat", _sweep(_EV, _ONE) + _islands("2", "3") + _contributors(flat=True))
def flat(spark, d):
    ds = events(spark, d)
    return _named_groups(ds.flat(2, 3, bin_size=BIN), ds, None)


@query("histogram", _sweep(_EV, _ONE) + ", f AS (SELECT g, chrom, s, p AS l, q AS r, d AS top FROM t WHERE d BETWEEN 1 AND 10 AND d > 0)" + _contributors())
def histogram(spark, d):
    ds = events(spark, d)
    return _named_groups(ds.histogram(1, "ALL", bin_size=BIN), ds, None)


@query("summit", _sweep(_EV, _ONE) + f", f AS (SELECT g, chrom, s, p AS l, q AS r, d AS top FROM t WHERE {_within('d', '2', '4')} AND ((d > b AND (n < d OR NOT {_within('n', '2', '4')})) OR (NOT {_within('b', '2', '4')} AND n < d)))" + _contributors())
def summit(spark, d):
    ds = events(spark, d)
    return _named_groups(ds.summit(2, 4, bin_size=BIN), ds, None)


@query("cover_groups", _sweep(_PLUS_MINUS, _BY) + _islands("2", "9223372036854775807") + _contributors(aggs=", CAST(cn AS DOUBLE) AS n, cv AS top"))
def cover_groups(spark, d):
    ds = items(spark, d).select(region=("not", ("cmp", ("coord", "strand"), "==", "*")))
    out = ds.cover(2, "ANY", ["group"], [Agg("COUNT", None, "n"), Agg("MAX", "score", "top")], bin_size=BIN)
    return _named_groups(out, ds, "group")


@query("cover_all", _sweep(_EV, _BY).replace("gs AS (", "gs AS MATERIALIZED (") + ", sz AS (SELECT g AS gg, count(*) AS cnt FROM gs GROUP BY g), t2 AS (SELECT * FROM t JOIN sz ON g = gg)" + _islands("(cnt // 2)", "((cnt + 3) // 1)").replace("FROM t WHERE", "FROM t2 WHERE") + _contributors())
def cover_all(spark, d):
    ds = events(spark, d)
    return _named_groups(ds.cover(("ALL/", 2), ("ALL+", 3, 1), ["group"], bin_size=BIN), ds, "group")


# results and the statement language


@query("take", ", o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY chrom, l, r, s) AS k FROM (SELECT DISTINCT sid, chrom, l, r, s FROM li)) SELECT sid AS sample_id, chrom, l AS \"left\", r AS \"right\", s AS strand FROM o WHERE k <= 7")
def take(spark, d):
    return items(spark, d).group().take(7).regions


@query("profile", """SELECT sid AS sample_id, CAST(count(*) AS BIGINT) AS regions, round(avg(r - l), 4) AS avg_length, min(l) AS min_left, max(r) AS max_right, min(r - l) AS min_length, max(r - l) AS max_length, round(var_pop(r - l), 4) AS var_length FROM li GROUP BY ROLLUP (sid)""")
def region_profile(spark, d):
    return rounded(profile(items(spark, d)), 4)


@query("lines_tab", f"SELECT {COORD}, score, discount, tax, linestatus FROM li")
def lines_tab(spark, d):
    """Written as tab-separated lines with 1-based starts and read back."""
    ds = items(spark, d)
    layout = Parser(0, 1, 2, 3, ((4, "score", "DOUBLE"), (5, "discount", "DOUBLE"), (6, "tax", "DOUBLE"), (7, "linestatus", "STRING")), one_based=True)
    return lines(tab_lines(ds, one_based=True).select("sample_id", "value"), layout)


@query("lines_gtf", f"SELECT {COORD}, 'regionframe' AS source, 'Region' AS feature, score, '.' AS frame, discount, linestatus FROM li")
def lines_gtf(spark, d):
    ds = items(spark, d).project(["score", "discount", "linestatus"])
    layout = parser_of(Schema("x", (("discount", "DOUBLE"), ("linestatus", "STRING")), "gtf"))
    return lines(gtf_lines(ds).select("sample_id", "value"), layout)


@query("lines_meta", "SELECT sid AS sample_id, attribute, value FROM meta")
def lines_meta(spark, d):
    meta = items(spark, d).meta
    return pairs(meta.select("sample_id", F.concat_ws("\t", "attribute", "value").alias("value")).unionByName(spark.createDataFrame([(0, "one field"), (0, "a\tb\tc")], "sample_id long, value string")))


SCRIPT = """
# positive regions of the even samples against the odd ones
A = SELECT(region: strand == '+') E;
B = SELECT(NOT(group == 'g9'); region: tax >= 0.02) O;
M = MAP(total AS SUM(score), lo AS MIN(tax); joinby: group; count_name: n) A B;
MATERIALIZE M INTO result;
"""


@query("script", f"""{_PAIRS}, p AS (SELECT DISTINCT sid, chrom, l, r, s, score, discount, tax, linestatus, count(*) OVER (PARTITION BY sid, chrom, l, r, s, score, discount, tax, linestatus) AS m FROM ev_e WHERE s = '+'),
k AS (SELECT a.sid, a.chrom, a.l, a.r, a.score, a.discount, a.tax, a.linestatus, b.sid AS j, count(*) * any_value(a.m) AS n, round(CAST(sum(CAST(b.score AS DECIMAL(18, 2))) * any_value(a.m) AS DOUBLE), 2) AS total, min(b.tax) AS lo FROM p a JOIN od b ON {_LAP} AND b.tax >= 0.02 GROUP BY ALL)
SELECT p.sid AS ref_id, pr.j AS exp_id, p.chrom, p.l AS "left", p.r AS "right", p.s AS strand, p.score, CAST(coalesce(n, 0) AS DOUBLE) AS n, total, lo FROM p JOIN pr ON pr.i = p.sid LEFT JOIN k ON k.sid = p.sid AND k.chrom = p.chrom AND k.l = p.l AND k.r = p.r AND k.score = p.score AND k.discount = p.discount AND k.tax = p.tax AND k.linestatus = p.linestatus AND k.j = pr.j""")
def script(spark, d):
    x, y = eo(spark, d)
    out = Script({"E": x, "O": y}, bin_size=BIN).run(SCRIPT)["result"]
    return rounded(lineage(out.project(["discount", "tax", "linestatus"], all_but=True).regions, spark))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_aggregates(spark, sf_dir)
