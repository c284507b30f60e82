"""Marginals, synthetic tables and their utility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pareto, synthetic, utility
from ..registry import query, rounded, table
from .anonymize import U


def _lap(tag: str, key: str, eps: float = 1.0) -> str:
    u = f"(({U(tag, key)} * 4294967296.0 + 0.5) / 4294967296.0 - 0.5)"
    return f"(-sign({u}) * {1 / eps} * ln(1 - 2 * abs({u})))"


_Y2 = f"WITH c AS (SELECT c_mktsegment AS value, greatest(0.0, count(*) + {_lap('dp-c_mktsegment', 'c_mktsegment')}) AS noisy FROM customer GROUP BY 1) SELECT value, round(noisy, 6) AS noisy, round(noisy / (SELECT sum(noisy) FROM c), 6) AS p FROM c"


@query("y2_categorical_marginal", _Y2)
def y2(spark, d):
    return rounded(synthetic.categorical_marginal(table(spark, d, "customer"), "c_mktsegment"))


_EDGE = "(SELECT CAST(min(p_size) AS DOUBLE) AS a, CAST(max(p_size) AS DOUBLE) AS b FROM part)"
_Y3 = f"""WITH e AS {_EDGE}, c AS (SELECT least(19, CAST(floor((p_size - a) / ((b - a) / 20)) AS INTEGER)) AS bin, count(*) AS c FROM part, e GROUP BY 1),
g AS (SELECT CAST(i AS INTEGER) AS bin, a + (b - a) / 20 * i AS lo, a + (b - a) / 20 * (i + 1) AS hi, greatest(0.0, coalesce(c, 0) + {_lap('dp-p_size', 'i')}) AS noisy FROM e, range(20) r(i) LEFT JOIN c ON c.bin = i)
SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round(noisy, 6) AS noisy, round(noisy / (SELECT sum(noisy) FROM g), 6) AS p FROM g"""


@query("y3_numeric_marginal", _Y3)
def y3(spark, d):
    return rounded(synthetic.numeric_marginal(table(spark, d, "part"), "p_size"))


@query(
    "y5_stratified_permutation",
    f"""WITH a AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
b AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY {U('shuffle-c_mktsegment', 'c_custkey')}, c_custkey) AS r FROM customer) SELECT c_custkey, c_nationkey, c_mktsegment FROM a JOIN b USING (c_nationkey, r)""",
)
def y5(spark, d):
    return synthetic.stratified_permutation(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_mktsegment", ["c_nationkey"], "c_custkey")


def made(spark, d):
    real = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return real, synthetic.generate(real, ["c_mktsegment", "c_acctbal"], ["c_nationkey"], key="c_custkey")


# The whole of Y6 for the two columns and the one that is taken from real rows.
_MADE = f"""sc AS (SELECT c_mktsegment AS value, greatest(0.0, count(*) + {_lap('dp-c_mktsegment', 'c_mktsegment')}) AS noisy FROM customer GROUP BY 1),
sp AS (SELECT value, noisy / (SELECT sum(noisy) FROM sc) AS p FROM sc), sr AS (SELECT value, p, sum(p) OVER (ORDER BY value) AS upto FROM sp WHERE p > 0),
be AS (SELECT CAST(min(c_acctbal) AS DOUBLE) AS a, CAST(max(c_acctbal) AS DOUBLE) AS b FROM customer),
bc AS (SELECT least(19, CAST(floor((CAST(c_acctbal AS DOUBLE) - a) / ((b - a) / 20)) AS INTEGER)) AS bin, count(*) AS c FROM customer, be GROUP BY 1),
bn AS (SELECT CAST(i AS INTEGER) AS bin, a + (b - a) / 20 * i AS lo, a + (b - a) / 20 * (i + 1) AS hi, greatest(0.0, coalesce(c, 0) + {_lap('dp-c_acctbal', 'i')}) AS noisy FROM be, range(20) r(i) LEFT JOIN bc ON bc.bin = i),
bp AS (SELECT *, noisy / (SELECT sum(noisy) FROM bn) AS p FROM bn), br AS (SELECT lo, hi, p, sum(p) OVER (ORDER BY bin) AS upto FROM bp WHERE p > 0),
ids AS (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS id),
us AS (SELECT id, {U('sample-c_mktsegment', 'id')} * (1 - 1e-12) AS us, {U('sample-c_acctbal', 'id')} * (1 - 1e-12) AS ub, {U('within-c_acctbal', 'id')} AS uw FROM ids),
nk AS (SELECT c_nationkey, row_number() OVER (ORDER BY {U('resample', 'c_custkey')}, c_custkey) - 1 AS id FROM customer),
syn AS (SELECT id, value AS c_mktsegment, lo + uw * (hi - lo) AS c_acctbal, c_nationkey FROM us JOIN sr ON us >= sr.upto - sr.p AND us < sr.upto JOIN br ON ub >= br.upto - br.p AND ub < br.upto JOIN nk USING (id))"""


@query("y6_generate", f"WITH {_MADE} SELECT id, c_mktsegment, round(c_acctbal, 6) AS c_acctbal, c_nationkey FROM syn")
def y6(spark, d):
    return rounded(made(spark, d)[1])


@query("y8_tvd", "WITH a AS (SELECT o_orderpriority AS v, count(*) FILTER (o_orderstatus = 'F') AS x, count(*) FILTER (o_orderstatus = 'O') AS y FROM orders GROUP BY 1) SELECT round(0.5 * sum(abs(x / (SELECT sum(x) FROM a) - y / (SELECT sum(y) FROM a))), 6) AS tvd FROM a")
def y8(spark, d):
    o = table(spark, d, "orders")
    return rounded(utility.tvd(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_orderpriority"))


@query("y9_ks", "WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, count(*) FILTER (o_orderstatus = 'F') AS x, count(*) FILTER (o_orderstatus = 'O') AS y FROM orders GROUP BY 1), c AS (SELECT sum(x) OVER (ORDER BY v) / (SELECT sum(x) FROM v) AS fx, sum(y) OVER (ORDER BY v) / (SELECT sum(y) FROM v) AS fy FROM v) SELECT round(max(abs(fx - fy)), 6) AS ks FROM c")
def y9(spark, d):
    o = table(spark, d, "orders")
    return rounded(utility.ks(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_totalprice"))


@query("y10_missingness", "SELECT 'v' AS \"column\", round(avg(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS real, 0.0::DOUBLE AS synthetic, round(avg(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS difference FROM customer")
def y10(spark, d):
    c = table(spark, d, "customer")
    return rounded(utility.missingness(c.select(F.expr("nullif(c_mktsegment, 'HOUSEHOLD')").alias("v")), c.select(F.col("c_mktsegment").alias("v")), ["v"]))


@query("y12_propensity_scores")
def y12(spark, d):
    real, syn = made(spark, d)
    return rounded(utility.propensity(real, syn, ["c_mktsegment", "c_acctbal", "c_nationkey"])["histogram"])


@query(
    "y13_nndr",
    f"""WITH {_MADE}, st AS (SELECT avg(CAST(c_acctbal AS DOUBLE)) AS ma, stddev_pop(CAST(c_acctbal AS DOUBLE)) AS sa, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer),
re AS (SELECT c_custkey AS k, (CAST(c_acctbal AS DOUBLE) - ma) / sa AS p, (c_nationkey - mn) / sn AS q FROM customer, st), sy AS (SELECT id AS k, (c_acctbal - ma) / sa AS p, (c_nationkey - mn) / sn AS q FROM syn, st),
dr AS (SELECT x.k, min(sqrt((x.p - y.p) * (x.p - y.p) + (x.q - y.q) * (x.q - y.q))) AS d FROM re x JOIN re y ON x.k <> y.k GROUP BY 1),
ds AS (SELECT x.k, min(sqrt((x.p - y.p) * (x.p - y.p) + (x.q - y.q) * (x.q - y.q))) AS d FROM sy x, re y GROUP BY 1),
o AS (SELECT (SELECT avg(d) FROM dr) AS rm, (SELECT min(d) FROM dr) AS rl, (SELECT avg(d) FROM ds) AS sm, (SELECT min(d) FROM ds) AS sl)
SELECT round(rm, 6) AS real_mean, round(rl, 6) AS real_least, round(sm, 6) AS synthetic_mean, round(sl, 6) AS synthetic_least, round(sm / rm, 6) AS ratio FROM o""",
)
def y13(spark, d):
    real, syn = made(spark, d)
    return rounded(utility.nndr(real, syn, ["c_acctbal", "c_nationkey"]))


def _cm2(column: str, first: str, second: str) -> str:
    """The product of 1 - rho^2 of two and two columns, as a quotient of determinants of their covariances."""
    cov = ", ".join(f"covar_pop({x}, {y}) AS {n}" for n, x, y in (("a", "x1", "x1"), ("b", "x1", "x2"), ("d", "x2", "x2"), ("f", "y1", "y1"), ("g", "y1", "y2"), ("h", "y2", "y2"), ("p", "x1", "y1"), ("q", "x1", "y2"), ("r", "x2", "y1"), ("s", "x2", "y2")))
    m11, m12, m22 = "(d*p*p - 2*b*p*r + a*r*r) / (a*d - b*b)", "(d*p*q - b*(p*s + q*r) + a*r*s) / (a*d - b*b)", "(d*q*q - 2*b*q*s + a*s*s) / (a*d - b*b)"
    side = f"row_number() OVER (ORDER BY {first}, {second}) AS k"
    return f"""SELECT '{column}' AS "column", ((f - {m11}) * (h - {m22}) - (g - {m12}) * (g - {m12})) / (f*h - g*g) AS cm2 FROM (SELECT {cov} FROM
(SELECT c_acctbal AS x1, c_nationkey AS x2, {side} FROM re) JOIN (SELECT c_acctbal AS y1, c_nationkey AS y2, {side} FROM syn) USING (k))"""


@query(
    "y14_cm3",
    f"""WITH {_MADE}, re AS (SELECT CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_nationkey FROM customer), m AS ({_cm2('c_acctbal', 'c_acctbal', 'c_nationkey')} UNION ALL {_cm2('c_nationkey', 'c_nationkey', 'c_acctbal')})
SELECT "column", round(cm2, 6) AS cm2, cm2 = (SELECT min(cm2) FROM m) AS is_min, (SELECT CASE WHEN min(cm2) >= 0.75 THEN 'high' WHEN min(cm2) >= 0.4 THEN 'medium' ELSE 'low' END FROM m) AS band FROM m""",
)
def y14(spark, d):
    real, syn = made(spark, d)
    r = utility.cm3(real, syn, ["c_acctbal", "c_nationkey"])
    return rounded(spark.createDataFrame([(c, x, c == r["min_column"], r["band"]) for c, x in r["cm2"].items()], "column string, cm2 double, is_min boolean, band string"))


@query("x12_pareto_front", "WITH p AS (SELECT p_partkey, p_size, CAST(p_retailprice AS DOUBLE) AS price FROM part) SELECT p_partkey, p_size, price FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_size <= a.p_size AND b.price <= a.price AND (b.p_size < a.p_size OR b.price < a.price))")
def x12(spark, d):
    return pareto.pareto_front(table(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("price")), "p_size", "price")


@query(
    "x11_x13_selected_solution",
    "WITH g AS (SELECT p_partkey, 2 + p_size % 19 AS k, (p_partkey % 11) / 10.0::DOUBLE AS level FROM part), s AS (SELECT p_partkey, 5.0::DOUBLE / k AS privacy_risk, 0.7 * level + 0.3 AS utility_loss FROM g), f AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.privacy_risk <= a.privacy_risk AND b.utility_loss <= a.utility_loss AND (b.privacy_risk < a.privacy_risk OR b.utility_loss < a.utility_loss))), m AS (SELECT max(privacy_risk) AS p, max(utility_loss) AS u FROM f) SELECT p_partkey, round(privacy_risk, 6)::DOUBLE AS privacy_risk, round(utility_loss, 6)::DOUBLE AS utility_loss, round(0.6 * privacy_risk / p + 0.4 * utility_loss / u, 6)::DOUBLE AS score FROM f, m ORDER BY 0.6 * privacy_risk / p + 0.4 * utility_loss / u, f.privacy_risk, f.utility_loss, p_partkey LIMIT 5",
)
def x13(spark, d):
    grid = table(spark, d, "part").select("p_partkey", (2 + F.col("p_size") % 19).alias("k"), ((F.col("p_partkey") % 11) / 10.0).alias("level"))
    front = pareto.pareto_front(pareto.closed_form_scores(grid), "privacy_risk", "utility_loss")
    return rounded(pareto.select_solution(front, "privacy_risk", "utility_loss", top=5).select("p_partkey", "privacy_risk", "utility_loss", "score"))


@query("x9_parameter_search")
def x9(spark, d):
    c = table(spark, d, "customer")
    best, front = pareto.search(pareto.measured_objectives(c, ["c_nationkey", "c_mktsegment"]))
    return rounded(spark.createDataFrame([(x["k"], x["l"], x["t"], x["level"], float(v[0]), float(v[1]), x == best) for x, v in front], "k int, l int, t double, level double, risk double, loss double, best boolean"))


@query("s11_codebook", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS o_orderstatus_lbl, CASE o_shippriority WHEN 0 THEN 'none' END AS o_shippriority_lbl FROM (SELECT *, 0 AS o_shippriority FROM orders)")
def s11(spark, d):
    o = table(spark, d, "orders").withColumn("o_shippriority", F.lit(0))
    return synthetic.apply_codebook(o, {"o_orderstatus": {"F": "finished", "O": "open"}, "o_shippriority": {"0": "none"}}).select("o_orderkey", "o_orderstatus_lbl", "o_shippriority_lbl")
