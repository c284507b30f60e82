"""Risk metrics over customer, and over orders with their customers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classes, risk
from ..registry import query, rounded, table

QI = ["c_nationkey", "c_mktsegment"]
QI4 = ["o_orderstatus", "o_orderpriority", "c_nationkey", "c_mktsegment"]
EC = "SELECT c_nationkey, c_mktsegment, count(*) AS s FROM customer GROUP BY ALL"
OC = "SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"


def ordered(spark, d: str) -> DataFrame:
    """Orders with their customers."""
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _level(s: str) -> str:
    return f"CASE WHEN {s} = 1 THEN 'CRITICAL' WHEN {s} < 3 THEN 'HIGH' WHEN {s} < 5 THEN 'MEDIUM' ELSE 'LOW' END"


def _pct_level(k: str, pct: str) -> str:
    return f"CASE WHEN {k} = 1 AND {pct} >= 50 THEN 'CRITICAL' WHEN {k} = 1 AND {pct} >= 20 THEN 'HIGH' WHEN {k} <= 2 AND {pct} >= 10 THEN 'MEDIUM' ELSE 'LOW' END"


@query("r1_equivalence_classes", f"SELECT c_nationkey, c_mktsegment, s AS class_size, row_number() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS equivalence_class FROM ({EC})")
def r1(spark, d):
    return classes.numbered_classes(table(spark, d, "customer"), QI).withColumn("equivalence_class", F.col("equivalence_class").cast("long"))


_K = """SELECT min(s) AS k, max(s) AS max_size, round(avg(s), 6) AS avg_size, CAST(quantile_cont(CAST(s AS DOUBLE), 0.5) AS DOUBLE) AS median_size, count(*) AS total_classes,
 count(*) FILTER (s = 1) AS unique_records, CAST(sum(s) AS BIGINT) AS total_records, round(100.0 * count(*) FILTER (s = 1) / sum(s), 2) AS unique_record_pct,
 round(100.0 * count(*) FILTER (s = 1) / count(*), 2) AS unique_class_pct FROM ({ec})"""


@query("r2_k_metrics", f"SELECT *, {_pct_level('k', 'unique_record_pct')} AS risk_level FROM ({_K.format(ec=EC)})")
def r2(spark, d):
    return rounded(risk.k_metrics(table(spark, d, "customer"), QI))


@query("r4_riskiest_classes", f"SELECT c_nationkey, c_mktsegment, s AS class_size, {_level('s')} AS risk_level FROM ({EC}) ORDER BY s, c_nationkey, c_mktsegment LIMIT 10")
def r4(spark, d):
    return risk.riskiest_classes(table(spark, d, "customer"), QI)


_SETS = [c for m in (1, 2, 3) for c in combinations(QI4, m)]
_R5 = " UNION ALL ".join(f"SELECT '{','.join(c)}' AS combination, {len(c)} AS n_columns, count(*) AS s FROM oc GROUP BY {','.join(c)}" for c in _SETS)


@query(
    "r5_qi_search",
    f"""WITH oc AS ({OC}), g AS ({_R5}),
a AS (SELECT combination, n_columns, min(s) AS k_min, round(100.0 * count(*) FILTER (s = 1) / count(*), 2) AS unique_class_pct, count(*) AS total_groups, round(avg(s), 6) AS avg_size, max(s) AS max_size,
 count(*) FILTER (s = 1) AS unique_groups FROM g GROUP BY 1, 2) SELECT *, {_pct_level('k_min', 'unique_class_pct')} AS risk_level FROM a""",
)
def r5(spark, d):
    return rounded(risk.combination_search(ordered(spark, d), QI4, 3))


@query("r6_l_diversity", f"SELECT c_nationkey, c_mktsegment, count(*) AS class_size, count(DISTINCT o_orderpriority) AS l_value FROM ({OC}) GROUP BY ALL")
def r6(spark, d):
    return risk.l_diversity(ordered(spark, d), QI, "o_orderpriority")


@query("r6_l_summary", f"SELECT min(l) AS l_min, round(avg(l), 6) AS l_avg, count(*) AS total_classes, count(*) FILTER (l < 2) AS homogeneous_classes FROM (SELECT count(DISTINCT o_orderpriority) AS l FROM ({OC}) GROUP BY c_nationkey, c_mktsegment)")
def r6s(spark, d):
    return rounded(risk.l_summary(ordered(spark, d), QI, "o_orderpriority"))


@query("r7_size_histogram", f"SELECT s AS class_size, count(*) AS n_classes FROM ({EC}) GROUP BY 1")
def r7(spark, d):
    return risk.size_histogram(table(spark, d, "customer"), QI)


_PROFILE = """WITH e AS (SELECT count(*) AS s, count(DISTINCT {sa}) AS l FROM ({src}) GROUP BY {qi}), n AS (SELECT CAST(sum(s) AS BIGINT) AS n FROM e),
a AS (SELECT n, count(*) AS n_classes, min(s) AS min_group_size, avg(s) AS avg_group_size, max(s) AS max_group_size, avg(CASE WHEN s < 5 THEN 1.0 ELSE 0.0 END) AS rare_combinations_ratio,
 max(CASE WHEN l = 1 THEN least(1.0, s / 10) ELSE 0.0 END) AS attribute_disclosure_risk, min(l) AS sensitive_distinct_min, count(*) / n AS unique_records_ratio,
 least(1.0, sum(CASE WHEN s = 1 THEN 1 - pow((n - 1) / n, n) WHEN s = 2 THEN 0.5 * (1 - pow((n - 2) / n, n)) ELSE 1 / s END) / n) AS population_uniqueness, least(1.0, 10 * count(*) / n) AS prosecutor_risk,
 sum(CASE WHEN s <= 5 THEN s ELSE 0 END) / n AS journalist_risk, CASE WHEN n <= 1 THEN 0.0 ELSE least(1.0, 1 - sum(pow(s / n, 2)) + CASE WHEN min(l) < 2 THEN 0.3 ELSE 0.0 END) END AS marketer_risk,
 least(1.0, count(*) / n * 1.1) AS linkage_risk FROM e, n GROUP BY n)
SELECT n, n_classes, min_group_size, round(avg_group_size, 6) AS avg_group_size, max_group_size, CAST(round(rare_combinations_ratio, 6) AS DOUBLE) AS rare_combinations_ratio, CAST(round(attribute_disclosure_risk, 6) AS DOUBLE) AS attribute_disclosure_risk,
 sensitive_distinct_min, round(unique_records_ratio, 6) AS unique_records_ratio, CAST(round(population_uniqueness, 6) AS DOUBLE) AS population_uniqueness, CAST(round(prosecutor_risk, 6) AS DOUBLE) AS prosecutor_risk, round(journalist_risk, 6) AS journalist_risk,
 CAST(round(marketer_risk, 6) AS DOUBLE) AS marketer_risk, CAST(round(linkage_risk, 6) AS DOUBLE) AS linkage_risk,
 CAST(round(0.25 * prosecutor_risk + 0.2 * journalist_risk + 0.15 * marketer_risk + 0.2 * attribute_disclosure_risk + 0.2 * linkage_risk, 6) AS DOUBLE) AS overall_risk FROM a"""


@query("r9_r17_risk_profile", _PROFILE.format(sa="o_orderpriority", src=OC, qi="c_nationkey, c_mktsegment"))
def r9(spark, d):
    return rounded(risk.risk_profile(ordered(spark, d), QI, "o_orderpriority"))


@query("r10_column_uniqueness", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio FROM ({OC})" for c in QI4))
def r10(spark, d):
    return rounded(risk.column_uniqueness(ordered(spark, d), QI4))


_TVD = f"""WITH oc AS ({OC}), c AS (SELECT c_nationkey, o_orderpriority, count(*) AS c FROM oc GROUP BY ALL), s AS (SELECT c_nationkey, count(*) AS s FROM oc GROUP BY ALL),
q AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM oc) AS q FROM oc GROUP BY ALL)
SELECT c_nationkey, s AS class_size, round(0.5 * sum(abs(coalesce(c, 0) / s - q)), 6) AS distance FROM s CROSS JOIN q LEFT JOIN c USING (c_nationkey, o_orderpriority) GROUP BY ALL"""


@query("r22_t_closeness_tvd", _TVD)
def r22(spark, d):
    return rounded(risk.class_distances(ordered(spark, d), ["c_nationkey"], "o_orderpriority"))


_EMD = """WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, count(*) AS c FROM lineitem GROUP BY ALL), s AS (SELECT l_returnflag, l_linestatus, count(*) AS s FROM lineitem GROUP BY ALL),
q AS (SELECT v, sum(g) OVER (ORDER BY v) / (SELECT count(*) FROM lineitem) AS q, count(*) OVER () AS m FROM (SELECT l_quantity AS v, count(*) AS g FROM lineitem GROUP BY ALL)),
p AS (SELECT l_returnflag, l_linestatus, s, q, m, sum(coalesce(c, 0)) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) / s AS p FROM s CROSS JOIN q LEFT JOIN c USING (l_returnflag, l_linestatus, v))
SELECT l_returnflag, l_linestatus, s AS class_size, round(least(1.0, sum(abs(p - q)) / (2 * greatest(1, max(m) - 1))), 6) AS distance FROM p GROUP BY ALL"""


@query("r22_t_closeness_emd", _EMD)
def r22e(spark, d):
    return rounded(risk.class_distances(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "emd"))


@query(
    "r21_constraint_checks",
    f"""WITH k AS (SELECT s AS x FROM ({EC.replace('FROM customer', f'FROM ({OC})')})), l AS (SELECT count(DISTINCT o_orderpriority) AS x FROM ({OC}) GROUP BY c_nationkey, c_mktsegment),
t AS (WITH oc AS ({OC}), c AS (SELECT c_nationkey, c_mktsegment, o_orderpriority, count(*) AS c FROM oc GROUP BY ALL), s AS (SELECT c_nationkey, c_mktsegment, count(*) AS s FROM oc GROUP BY ALL),
 q AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM oc) AS q FROM oc GROUP BY ALL)
 SELECT 0.5 * sum(abs(coalesce(c, 0) / s - q)) AS x FROM s CROSS JOIN q LEFT JOIN c USING (c_nationkey, c_mktsegment, o_orderpriority) GROUP BY c_nationkey, c_mktsegment),
a AS (SELECT 'k_anonymity' AS "constraint", 5.0::DOUBLE AS required, min(x)::DOUBLE AS actual, count(*) FILTER (x >= 5) AS compliant_classes, count(*) AS total_classes FROM k
 UNION ALL SELECT 'l_diversity', 2.0, min(x), count(*) FILTER (x >= 2), count(*) FROM l UNION ALL SELECT 't_closeness', 0.3, max(x), count(*) FILTER (x <= 0.3), count(*) FROM t)
SELECT "constraint", required, round(actual, 6) AS actual, compliant_classes, total_classes, round(compliant_classes / total_classes, 6) AS rate, compliant_classes = total_classes AS valid FROM a""",
)
def r21(spark, d):
    return rounded(risk.constraint_checks(ordered(spark, d), QI, "o_orderpriority"))


@query(
    "r19_rare_values_ratio",
    "WITH v AS (SELECT 'p_brand' AS c, p_brand AS v, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY ALL) "
    "SELECT round(count(*) FILTER (n < least(5.0, greatest(1.0, 0.05 * (SELECT count(*) FROM part)))) / count(*), 6) AS rare_values_ratio FROM v",
)
def r19(spark, d):
    return rounded(risk.rare_values_ratio(table(spark, d, "part"), ["p_brand", "p_type", "p_size"]))


_R20 = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) / count(*) AS u FROM part" for c in ("p_brand", "p_type", "p_container") if c != "p_container")


@query(
    "r20_categorical_risk",
    f"""SELECT "column", n_unique, round(u, 6) AS unique_ratio, CAST(round((CASE WHEN u < 0.01 THEN 0.3 WHEN u < 0.05 THEN 0.4 WHEN u < 0.2 THEN 0.8 ELSE least(1.0, 2 * u) END
 + CASE WHEN n_unique <= 3 THEN 0.3 WHEN n_unique <= 10 THEN 0.6 WHEN n_unique <= 50 THEN 0.8 ELSE 1.0 END) / 2, 6) AS DOUBLE) AS risk_score FROM ({_R20})""",
)
def r20(spark, d):
    return rounded(risk.categorical_risk(table(spark, d, "part"), ["p_brand", "p_type"]))
