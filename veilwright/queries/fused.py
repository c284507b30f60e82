"""Risk fused from scores that the tables hold, and small reports, each with SQL: what follows the models without the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.durable import materialise
from ..operators import anonymize, attack, fusion, profile, risk, synthetic
from ..plans import expert
from ..registry import query, rounded, table
from .risk import OC, QI, ordered

# Each order is a record, its lines are pairs with the discount as attack score.
_SCORES = "SELECT l_orderkey AS anon_index, max(CAST(l_discount AS DOUBLE)) AS a FROM lineitem GROUP BY 1"
_FINAL = f"""i AS (SELECT o_orderkey AS anon_index, 1.0 / count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS u FROM ({OC})),
b AS (SELECT anon_index, a, 0.6 * u AS c, u FROM ({_SCORES}) LEFT JOIN i USING (anon_index)),
e AS (SELECT min(a) AS al, max(a) AS ah, min(c) AS cl, max(c) AS ch, min(u) AS ul, max(u) AS uh FROM b),
f AS (SELECT anon_index, 100 * (0.5 * coalesce((a - al) / nullif(ah - al, 0), 0) + 0.3 * coalesce((c - cl) / nullif(ch - cl, 0), 0) + 0.2 * coalesce((u - ul) / nullif(uh - ul, 0), 0)) AS s FROM b, e)"""


def scores(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("anon_index"), F.col("l_discount").cast("double").alias("attack_score"))


def final(spark, d):
    internal = fusion.internal_risk(ordered(spark, d), "o_orderkey", QI)
    return materialise(fusion.final_risk(fusion.record_risk(scores(spark, d)), internal), "final")


@query("r31_d4_fused_risk", f"WITH {_FINAL} SELECT anon_index, round(s, 6)::DOUBLE AS final_risk_score, CASE WHEN s < 20 THEN 'low' WHEN s < 40 THEN 'moderate' WHEN s < 60 THEN 'high' WHEN s < 80 THEN 'very_high' ELSE 'critical' END AS final_risk_level FROM f")
def r31(spark, d):
    return rounded(final(spark, d).select("anon_index", "final_risk_score", "final_risk_level"))


_FEATURES = {"quantity_diff": "CAST(l_quantity AS DOUBLE) / 50", "discount_match": "CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END", "quantity_close": "CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END", "tax_ratio": "CAST(l_tax AS DOUBLE)", "flat_ratio": "1.5"}
_COLUMNS = f"""WITH {_FINAL}, p AS (SELECT l_orderkey AS anon_index, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _FEATURES.items())} FROM lineitem), j AS (SELECT p.*, s FROM p LEFT JOIN f USING (anon_index)),
m AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, avg(abs({n})) AS imp, {'NULL' if n == 'flat_ratio' else f'corr({n}, s)'}::DOUBLE AS r FROM j" for n in _FEATURES)} UNION ALL SELECT 'lost_diff', 0.25, NULL),
x AS (SELECT feature, imp, r, coalesce(abs(r), 0) AS ra FROM m), z AS (SELECT min(imp) AS il, max(imp) AS ih, min(ra) AS rl, max(ra) AS rh FROM x),
c AS (SELECT feature AS "column", imp AS shap_importance, r AS pair_risk_correlation, 100 * (0.7 * (imp - il) / (ih - il) + 0.3 * (ra - rl) / (rh - rl)) AS score FROM x, z)"""


def columns(spark, d):
    """The lines as pairs with features; a feature's importance is its mean size, and one has an importance but no column."""
    pairs = table(spark, d, "lineitem").selectExpr("l_orderkey AS anon_index", *(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FEATURES.items()))
    pairs = materialise(pairs, "pairs")
    importance = pairs.agg(*(F.avg(F.abs(n)).alias(n) for n in _FEATURES)).unpivot([], list(_FEATURES), "feature", "importance").unionByName(spark.createDataFrame([("lost_diff", 0.25)], "feature string, importance double"))
    return fusion.column_risk(importance, pairs, final(spark, d), list(_FEATURES))


@query("r32_d5_column_risk", f'{_COLUMNS} SELECT "column", round(shap_importance, 6)::DOUBLE AS shap_importance, round(pair_risk_correlation, 6) AS pair_risk_correlation, round(score, 6)::DOUBLE AS column_risk_score FROM c')
def r32(spark, d):
    return rounded(columns(spark, d).select("column", "shap_importance", "pair_risk_correlation", "column_risk_score"))


@query(
    "r34_vulnerable_rollup",
    f"""{_COLUMNS} SELECT regexp_replace("column", '_(diff|ratio|close|match)$', '') AS base, round(max(score), 6)::DOUBLE AS vulnerable_score, round(avg(score), 6)::DOUBLE AS mean_score, count(*) AS n_features FROM c GROUP BY 1 HAVING max(score) >= 1 ORDER BY max(score) DESC, 1 LIMIT 10""",
)
def r34(spark, d):
    return rounded(fusion.vulnerable_columns(columns(spark, d), 10, 1.0))


@query(
    "r35_top_contributions",
    """WITH l AS (SELECT o_orderkey AS aux_index, o_custkey AS anon_index, unnest([{'f': 'q', 'c': 25 - o_orderkey % 50}, {'f': 'd', 'c': o_custkey % 41 - 20}, {'f': 't', 'c': -(o_orderkey % 31)}, {'f': 'n', 'c': 7}]) AS x FROM orders),
r AS (SELECT aux_index, anon_index, x.f AS feature, x.c::DOUBLE AS contribution, row_number() OVER (PARTITION BY aux_index, anon_index ORDER BY abs(x.c) DESC, x.f) AS rank FROM l) SELECT aux_index, anon_index, feature, contribution, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def r35(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    each = {"q": 25 - k % 50, "d": c % 41 - 20, "t": -(k % 31), "n": F.lit(7)}
    local = table(spark, d, "orders").select(k.alias("aux_index"), c.alias("anon_index"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), x.cast("double").alias("contribution")) for n, x in each.items()))).alias("x"))
    return attack.top_features(local.select("aux_index", "anon_index", "x.*"))


@query("r36_nearest_rank_buckets", "WITH s AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders), l AS (SELECT list(x ORDER BY x) AS v FROM s) SELECT p AS share, v[least(len(v), floor(p * len(v))::BIGINT + 1)] AS value FROM l, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) t(p)")
def r36(spark, d):
    return fusion.nearest_rank_buckets(table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("x")), "x").select(F.col("share").cast("double").alias("share"), "value")


_R8 = """SELECT k, max_size, total_classes, unique_records, CASE WHEN k = 1 THEN 'CRITICAL' WHEN k < 3 THEN 'HIGH' WHEN k < 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
CASE WHEN k = 1 THEN printf('%.2f', round(100.0 * unique_records / n, 2)) || ' % of the records are unique' ELSE 'every record shares its class with at least ' || (k - 1) || ' others' END AS description
FROM (SELECT min(s) AS k, max(s) AS max_size, count(*) AS total_classes, count(*) FILTER (s = 1) AS unique_records, sum(s) AS n FROM (SELECT count(*) AS s FROM part GROUP BY {c}))"""


@query("r8_validated_risk", _R8.format(c="p_brand") + " UNION ALL " + _R8.format(c="p_brand, p_size"))
def r8(spark, d):
    p = table(spark, d, "part")
    cols = ["k", "max_size", "total_classes", "unique_records", "risk_level", "description"]
    return risk.validated(p, ["p_brand"]).select(*cols).unionByName(risk.validated(p, ["p_brand", "p_size"]).select(*cols))


@query("r26_risk_improvement", "SELECT o_orderkey, greatest(0, round(1 - CAST(o_totalprice AS DOUBLE) / 200000, 6)) AS improvement FROM orders")
def r26(spark, d):
    # Halves by the double itself, as SQL rounds it; ``round`` goes by its shortest decimal text.
    x = (1 - F.col("o_totalprice").cast("double") / 200000) * 1e6
    return table(spark, d, "orders").select("o_orderkey", risk.improvement(F.signum(x) * F.floor(F.abs(x) + 0.5) / 1e6, F.lit(0.0)).alias("improvement"))


_GAPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders"


@query(
    "p13_missing_report",
    f"WITH g AS ({_GAPS}), m AS (SELECT count(*) AS n, count(*) - count(o_orderkey) AS a, count(*) - count(o_orderstatus) AS b, count(*) - count(o_orderdate) AS c FROM g) SELECT 'o_orderkey' AS \"column\", a AS missing, round(100.0 * a / n, 2)::DOUBLE AS missing_pct FROM m UNION ALL SELECT 'o_orderstatus', b, round(100.0 * b / n, 2) FROM m UNION ALL SELECT 'o_orderdate', c, round(100.0 * c / n, 2) FROM m UNION ALL SELECT NULL, a + b + c, round(100.0 * (a + b + c) / (3 * n), 2) FROM m",
)
def p13(spark, d):
    key = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.when(key % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(key % 3 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return profile.missing_report(o)


@query("p8_p12_memory_and_types", "SELECT 'string' AS dtype, 2 AS n_columns, sum(strlen(c_name) + strlen(c_mktsegment))::BIGINT AS bytes FROM customer UNION ALL SELECT 'bigint', 1, 8 * count(c_custkey) FROM customer UNION ALL SELECT 'double', 1, 8 * count(c_acctbal) FROM customer")
def p8(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return profile.memory_and_types(c)


@query("p18_cleaned_strings", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_mktsegment) END AS clean FROM customer")
def p18(spark, d):
    text = F.when(F.col("c_custkey") % 10 == 0, " N/A ").when(F.col("c_custkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit("  "), F.initcap("c_mktsegment"), F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", X.clean_string(text).alias("clean"))


@query("p32_min_max", "WITH e AS (SELECT min(CAST(c_acctbal AS DOUBLE)) AS a, max(CAST(c_acctbal AS DOUBLE)) AS b FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE round((CAST(c_acctbal AS DOUBLE) - a) / (b - a), 6) END AS scaled, 0.0::DOUBLE AS flat FROM customer, e")
def p32(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x"))
    edge = c.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    x = F.when(F.col("c_custkey") % 9 != 0, F.col("x"))
    return c.join(F.broadcast(edge)).select("c_custkey", F.round(X.min_max(x, F.col("a"), F.col("b")), 6).alias("scaled"), X.min_max(F.col("x"), F.lit(1.0), F.lit(1.0)).alias("flat"))


@query("a32_mask_and_round", "SELECT c_custkey, left(c_name, 1) || '***' AS name, round(CAST(c_acctbal AS DOUBLE) / 1000) * 1000 + 0.0 AS balance FROM customer")
def a32(spark, d):
    return table(spark, d, "customer").select("c_custkey", anonymize.mask(F.col("c_name")).alias("name"), anonymize.rounded_to(F.col("c_acctbal")).alias("balance"))


@query(
    "y4_sampled_marginals",
    """WITH m AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1), c AS (SELECT v, sum(p) OVER (ORDER BY v) - p AS a, sum(p) OVER (ORDER BY v) AS b FROM m),
u AS (SELECT o_orderkey AS id, ('0x' || substr(md5('42|sample-x|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5('42|sample-y|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS w, ('0x' || substr(md5('42|within-y|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS z FROM orders)
SELECT id, v AS x, round(CASE WHEN w < 0.25 THEN 10 * z ELSE 10 + 20 * z END, 6)::DOUBLE AS y FROM u JOIN c ON u.u >= a AND u.u < b""",
)
def y4(spark, d):
    o = table(spark, d, "orders")
    total = o.agg(F.count(F.lit(1)).alias("n"))
    shares = materialise(o.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(total)).select("value", (F.col("c") / F.col("n")).alias("p")), "shares")
    bins = spark.createDataFrame([(0, 0.0, 10.0, 0.25), (1, 10.0, 30.0, 0.75)], "bin int, lo double, hi double, p double")
    out = synthetic.sample_marginal(o.select(F.col("o_orderkey").alias("id")), shares, "x", False)
    return rounded(synthetic.sample_marginal(out, bins, "y", True).select("id", "x", "y"))


@query(
    "r23_post_validation",
    f"""WITH o AS ({OC}), a AS (SELECT c_nationkey // 5 AS g, c_mktsegment AS m, CASE WHEN o_orderkey % 97 = 0 THEN 'other' ELSE o_orderpriority END AS p FROM o),
c AS (SELECT g, m, p, count(*) AS c FROM a GROUP BY ALL), s AS (SELECT g, m, count(*) AS s, count(DISTINCT p) AS l FROM a GROUP BY ALL), q AS (SELECT o_orderpriority AS p, count(*) / (SELECT count(*) FROM o) AS q FROM o GROUP BY 1),
v AS (SELECT p FROM q UNION SELECT p FROM c), d AS (SELECT g, m, 0.5 * sum(abs(coalesce(c, 0) / s - coalesce(q, 0))) AS d FROM s CROSS JOIN v LEFT JOIN c USING (g, m, p) LEFT JOIN q USING (p) GROUP BY g, m),
r AS (SELECT 'k_anonymity' AS "constraint", NULL AS "column", 100.0::DOUBLE AS required, min(s)::DOUBLE AS actual, count(*) FILTER (s < 100) AS failing_classes, 3 AS n FROM s UNION ALL SELECT 'l_diversity', 'o_orderpriority', 6.0, min(l), count(*) FILTER (l < 6), 3 FROM s UNION ALL SELECT 't_closeness', 'o_orderpriority', 0.02, max(d), count(*) FILTER (d > 0.02 + 1e-12), 3 FROM d)
SELECT "constraint", "column", required, round(actual, 6) AS actual, failing_classes = 0 AS met, failing_classes, CASE WHEN failing_classes = 0 THEN 0 ELSE n + CASE WHEN (SELECT count(*) FROM r WHERE failing_classes > 0) > 1 THEN 1 ELSE 0 END END AS n_actions FROM r""",
)
def r23(spark, d):
    o = ordered(spark, d)
    after = o.select(F.floor(F.col("c_nationkey") / 5).alias("g"), F.col("c_mktsegment").alias("m"), F.when(F.col("o_orderkey") % 97 == 0, "other").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    out = expert.post_validation(after, o, ["g", "m"], ["o_orderpriority"], 100, 6, 0.02)
    return rounded(out.withColumn("n_actions", F.size("actions")).drop("actions"))
