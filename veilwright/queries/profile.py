"""Profiling and column roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import classify as C
from ..operators import profile as P
from ..registry import query, rounded, table
from .risk import OC, ordered

PART = ["p_partkey", "p_brand", "p_type", "p_size"]


def part(spark, d):
    return table(spark, d, "part").select(*PART)


def _each(cols, sql: str) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in cols)


_TYPED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
_T = "trim(CAST({c} AS VARCHAR))"
_P2 = f"""SELECT '{{c}}' AS "column", CASE WHEN count({{c}}) = 0 THEN 'all_null' WHEN count(*) FILTER (TRY_CAST({_T} AS DOUBLE) = floor(TRY_CAST({_T} AS DOUBLE))) = count({{c}}) THEN 'integer'
 WHEN count(TRY_CAST({_T} AS DOUBLE)) = count({{c}}) THEN 'float' WHEN count(TRY_CAST({_T} AS TIMESTAMP)) >= 0.9 * count({{c}}) THEN 'datetime'
 WHEN count(*) FILTER (lower({_T}) IN ('true', 'false', 'yes', 'no', '0', '1')) >= 0.95 * count({{c}}) THEN 'boolean' ELSE 'string' END AS logical_type FROM """


@query("p2_infer_types", _each(_TYPED, _P2 + "lineitem") + " UNION ALL " + _each(["yes_no", "nothing"], _P2 + "(SELECT CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'no' END AS yes_no, CAST(NULL AS VARCHAR) AS nothing FROM lineitem)"))
def p2(spark, d):
    x = table(spark, d, "lineitem")
    return P.infer_types(x.select(*_TYPED, F.when(F.col("l_linestatus") == "F", "Yes").otherwise("no").alias("yes_no"), F.lit(None).cast("string").alias("nothing")))


@query("p3_profiling_stats", _each(PART, "SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS n_unique FROM part"))
def p3(spark, d):
    return P.profiling_stats(part(spark, d))

_SAMPLED = "SELECT '{c}' AS \"column\", array_to_string(list(left(v, 50) ORDER BY r) FILTER (r <= 5), ', ') AS samples, array_to_string(list(v ORDER BY r), '|') AS ten FROM (SELECT v, row_number() OVER (ORDER BY md5(v), v) AS r FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM lineitem WHERE {c} IS NOT NULL)) WHERE r <= 10"


@query("p3_p4_samples", _each(["l_orderkey", "l_returnflag", "l_shipdate", "l_linenumber"], _SAMPLED))
def p3_samples(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_shipdate").cast("string").alias("l_shipdate"), "l_linenumber")
    five, ten = P.sample_values(x), P.sample_values(x, 10, None)
    return five.select("column", F.array_join("samples", ", ").alias("samples")).join(ten.select("column", F.array_join("samples", "|").alias("ten")), "column")


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_P5 = """SELECT '{c}' AS "column", count(*) AS n, count({c}) AS present, round(min({c}), 6)::DOUBLE AS min, round(max({c}), 6)::DOUBLE AS max, round(avg({c}), 6)::DOUBLE AS mean, round(stddev_samp({c}), 6)::DOUBLE AS std,
 round(any_value(q1), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(any_value(q3), 6) AS q3, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS extreme,
 round(any_value(q3 - q1), 6) AS iqr, round(max({c}) - min({c}), 6)::DOUBLE AS range, 0.0::DOUBLE AS null_pct, round(100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 4)::DOUBLE AS outlier_pct
 FROM lineitem, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)"""


@query("p5_numeric_summary", _each(_NUM, _P5))
def p5(spark, d):
    return rounded(P.numeric_summary(table(spark, d, "lineitem").select(*_NUM)))


@query(
    "p4_column_summaries",
    _each(
        ["p_size", "p_brand"],
        "SELECT '{c}' AS \"column\", CASE WHEN '{c}' = 'p_size' THEN 'integer' ELSE 'string' END AS logical_type, count(*) AS total_rows, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct, count(DISTINCT {c}) AS n_unique, round(min(TRY_CAST({c} AS DOUBLE)), 6) AS min, round(max(TRY_CAST({c} AS DOUBLE)), 6) AS max, round(avg(TRY_CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(TRY_CAST({c} AS DOUBLE)), 6) AS std FROM part",
    ),
)
def p4(spark, d):
    return rounded(P.column_summaries(table(spark, d, "part").select("p_size", "p_brand")).drop("samples", "values"))


_CAT = ["p_brand", "p_type"]


@query("p6_categorical_summary", _each(_CAT, "SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS present, count(*) AS n_unique, arg_min(v, (-n, v)) AS most_frequent, max(n) AS most_frequent_count, count(*) FILTER (n < 0.01 * (SELECT count(*) FROM part)) AS rare_values, count(*) > 0.95 * sum(n) AS identifier_like FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1)"))
def p6(spark, d):
    return P.categorical_summary(part(spark, d), _CAT)


@query("p6_top_values", _each(_CAT, "SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM part GROUP BY {c}) WHERE rank <= 10"))
def p6t(spark, d):
    return P.top_values(part(spark, d), _CAT)


@query("p7_datetime_summary", _each(["o_orderdate"], "SELECT '{c}' AS \"column\", CAST(CAST(min({c}) AS DATE) AS VARCHAR) AS first, CAST(CAST(max({c}) AS DATE) AS VARCHAR) AS last, date_diff('day', CAST(min({c}) AS DATE), CAST(max({c}) AS DATE)) AS range_days FROM orders"))
def p7(spark, d):
    return P.datetime_summary(table(spark, d, "orders"), ["o_orderdate"])


@query("p8_overview", "WITH g AS (SELECT count(*) AS n FROM (SELECT p_brand, p_type, p_size FROM part) GROUP BY p_brand, p_type, p_size) SELECT CAST(sum(n) AS BIGINT) AS rows, 3::BIGINT AS columns, CAST(3 * sum(n) AS BIGINT) AS cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 4) AS duplicate_pct, 0::BIGINT AS missing_cells, 100.0::DOUBLE AS completeness_pct, 0::BIGINT AS columns_with_missing, 0::BIGINT AS empty_columns, 0::BIGINT AS constant_columns, true AS validation_passed FROM g")
def p8(spark, d):
    return P.overview(part(spark, d).drop("p_partkey"))


@query("p9_string_lengths", _each(_CAT, "SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_length, min(length({c})) AS min_length, max(length({c})) AS max_length FROM part"))
def p9(spark, d):
    return rounded(P.string_lengths(part(spark, d), _CAT))


_CATEGORY = """SELECT '{c}' AS "column", 'high_cardinality' AS kind, count(DISTINCT {c}) AS n FROM customer HAVING count(DISTINCT {c}) > 0.95 * count({c})
UNION ALL SELECT '{c}', 'rare_categories', count(*) FROM (SELECT count(*) AS k FROM customer WHERE {c} IS NOT NULL GROUP BY {c}) WHERE k < 0.01 * (SELECT count({c}) FROM customer) HAVING count(*) > 0"""
_EXTREME = """SELECT '{c}' AS "column", 'extreme_values' AS kind, count(*) AS n FROM {t}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {t}) WHERE b > a AND ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) HAVING count(*) > 0"""


@query("p14_anomalies", f"{_EXTREME.format(c='n_chars', t='documents')} UNION ALL {_EXTREME.format(c='c_acctbal', t='customer')} UNION ALL {_each(['c_name', 'c_mktsegment'], _CATEGORY)}")
def p14(spark, d):
    customers = P.anomalies(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), ("c_custkey",))
    return customers.unionByName(P.anomalies(table(spark, d, "documents").select("doc_id", "n_chars"), ("doc_id",)))


@query("p15_fallback_inspection", _each(["c_custkey"], "SELECT '{c}' AS \"column\", 'high_cardinality' AS kind, count(DISTINCT {c}) AS n FROM customer"))
def p15(spark, d):
    return P.fallback_inspection(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@query("p17_key_candidates", """WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders), b AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer),
u AS (SELECT 'k' AS "column", (SELECT count(DISTINCT k) / count(*) FROM a) AS ua, (SELECT count(DISTINCT k) / count(*) FROM b) AS ub, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) / least((SELECT count(DISTINCT k) FROM a), (SELECT count(DISTINCT k) FROM b)) AS overlap
UNION ALL SELECT 's', (SELECT count(DISTINCT s) / count(*) FROM a), (SELECT count(DISTINCT s) / count(*) FROM b), 0)
SELECT "column", round(ua, 6) AS ua, round(ub, 6) AS ub, round(overlap, 6)::DOUBLE AS overlap, round(20 * (ua + ub) + 20 * overlap, 6)::DOUBLE AS score, 20 * (ua + ub) + 20 * overlap >= 35 AS is_key, CASE WHEN ua > 0.95 AND ub > 0.95 THEN 'same_level' WHEN ua > 0.95 THEN 'parent_child' WHEN ub > 0.95 THEN 'event_to_entity' ELSE 'related' END AS relation FROM u""")
def p17(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return rounded(P.key_candidates(a, b))


@query("p20_entropy", _each(["o_orderstatus", "o_orderpriority"], "SELECT '{c}' AS \"column\", round(-sum(p * log2(p + 1e-10)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY {c})"))
def p20(spark, d):
    return rounded(P.entropy(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("p21_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def p21(spark, d):
    return rounded(P.correlations(table(spark, d, "lineitem"), _NUM))


@query("p22_z_outliers", _each(["l_quantity", "l_extendedprice"], "SELECT '{c}' AS \"column\", round(avg(CASE WHEN abs({c} - m) > 3 * s THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS outlier_share, avg(CASE WHEN abs({c} - m) > 3 * s THEN 1.0 ELSE 0.0 END) > 0.05 AS outliers_detected FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"))
def p22(spark, d):
    return rounded(P.z_outliers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("p24_value_overlap", "WITH a AS (SELECT DISTINCT lower(trim(l_shipmode)) AS v FROM (SELECT l_returnflag AS l_shipmode FROM lineitem)), b AS (SELECT DISTINCT lower(trim(o_orderstatus)) AS v FROM orders), c AS (SELECT count(*) AS common FROM a JOIN b USING (v)) SELECT common, (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, round(common / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS overlap FROM c")
def p24(spark, d):
    return rounded(P.value_overlap(table(spark, d, "lineitem"), "l_returnflag", table(spark, d, "orders"), "o_orderstatus"))


# Written out here, so that the SQL doesn't take its patterns from what it proves.
_WHOLE = {
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?\d[\d\s().-]{7,}\d$",
    "ip": r"^\d{1,3}(\.\d{1,3}){3}$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
_WITHIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+?\d[\d\s().-]{7,}\d", "nic": r"\b\d{9}[vVxX]\b|\b\d{12}\b", "passport": r"\b[A-Z]\d{7}\b"}
_RATE = " UNION ALL ".join(f"SELECT 'text' AS \"column\", '{k}' AS category, round(avg(CASE WHEN regexp_matches(text, '{p}') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM documents" for k, p in _WHOLE.items())


@query("p26_pattern_rates", f"SELECT *, CASE WHEN rate > 0.8 THEN 0.9 WHEN rate > 0.5 THEN 0.7 WHEN rate > 0.2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM ({_RATE})")
def p26(spark, d):
    return rounded(P.pattern_rates(table(spark, d, "documents"), ["text"]))


_HAS = " UNION ALL ".join(f"SELECT 'text' AS \"column\", '{k}' AS category, bool_or(regexp_matches(text, '{p}')) AS present FROM documents" for k, p in _WITHIN.items())


@query("p27_pattern_presence", f"{_HAS} UNION ALL SELECT 'text', 'address_like', bool_or(length(text) > 60) FROM documents")
def p27(spark, d):
    return P.pattern_presence(table(spark, d, "documents"), ["text"])


@query("p29_p31_similarity", f"SELECT o_orderkey, round(abs(a - b) / greatest(abs(a), abs(b), 1.0), 6) AS diff, round(CASE WHEN b <> 0 THEN a / b END, 6) AS ratio, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-01-01'))::INTEGER AS days, CASE WHEN year(o_orderdate) = 1995 THEN 1 ELSE 0 END AS same_year, CASE WHEN lower(trim(o_orderstatus)) = 'f' THEN 1 ELSE 0 END AS match FROM (SELECT *, CAST(o_totalprice AS DOUBLE) AS a, CAST(c_acctbal AS DOUBLE) AS b FROM ({OC}))")
def p29(spark, d):
    a, b, day = F.col("o_totalprice").cast("double"), F.col("c_acctbal").cast("double"), F.to_date(F.lit("1995-01-01"))
    return rounded(
        ordered(spark, d).select("o_orderkey", X.numeric_diff(a, b).alias("diff"), X.numeric_ratio(a, b).alias("ratio"), X.days_between(F.col("o_orderdate").cast("date"), day).alias("days"), X.same_year(F.col("o_orderdate"), day).alias("same_year"), X.category_match(F.col("o_orderstatus"), F.lit(" F ")).alias("match"))
    )


@query("p33_p34_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'changed' WHEN o_orderstatus = 'F' THEN 'match' ELSE 'changed' END AS status, CASE WHEN u >= 0.7 THEN 'High' WHEN u >= 0.4 THEN 'Medium' ELSE 'Low' END AS label FROM (SELECT *, (o_orderkey % 100) / 100.0::DOUBLE AS u FROM orders)")
def p33(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.cell_status(F.col("o_orderstatus"), F.lit("F")).alias("status"), X.attack_label((F.col("o_orderkey") % 100) / 100.0).alias("label"))


#: Words of the supplied tables.
TABLE_WORDS = C.Words().more(
    direct={"key": ("custkey", "orderkey", "comment")},
    quasi={"geography": ("nation", "nationkey"), "segment": ("segment", "mktsegment", "brand", "type", "category", "status", "orderstatus", "priority", "orderpriority"), "date": ("date", "orderdate", "shipdate")},
    sensitive={"income": ("acctbal", "totalprice", "price")},
)


# The rules of names as plain cases: a word of 9 in its category scores 1 / 9 + .3, one of 2 scores 1 / 2 + .3.
_ROLES = """u AS (SELECT count(DISTINCT c_custkey) / count(*) AS k, count(DISTINCT c_name) / count(*) AS n, count(DISTINCT c_mktsegment) / count(*) AS m, count(DISTINCT c_nationkey) / count(*) AS x FROM customer),
c1 AS (SELECT 'c_custkey' AS "column", CASE WHEN k > 0.95 THEN 'DIRECT_IDENTIFIER' ELSE 'NON_SENSITIVE' END AS role, CASE WHEN k > 0.95 THEN least(1.0, 0.95 + 0.1) ELSE 0.5 END AS confidence, 'word of the name, nearly unique' AS reasons FROM u
UNION ALL SELECT 'c_name', CASE WHEN n > 0.95 THEN 'DIRECT_IDENTIFIER' ELSE 'NON_SENSITIVE' END, CASE WHEN n > 0.95 THEN least(1.0, 0.95 + 0.1) ELSE 0.5 END, 'word of the name, nearly unique' FROM u
UNION ALL SELECT 'c_mktsegment', 'QUASI_IDENTIFIER', least(1, 1.2 * (1 / 9 + 0.3) + CASE WHEN m > 0.1 AND m < 0.9 THEN 0.1 ELSE 0 END), 'words of the name' FROM u
UNION ALL SELECT 'c_nationkey', 'QUASI_IDENTIFIER', least(1, 1.2 * (1 / 2 + 0.3) + CASE WHEN x > 0.1 AND x < 0.9 THEN 0.1 ELSE 0 END), 'words of the name' FROM u
UNION ALL SELECT 'c_acctbal', 'SENSITIVE', least(1, 1.3 * (1 / 9 + 0.3) + 0.2), 'words of the name' FROM u)"""


@query("c1_c6_column_roles", f'WITH {_ROLES} SELECT "column", role, round(confidence, 4)::DOUBLE AS confidence, reasons FROM c1')
def c1(spark, d):
    return C.role_table(spark, C.detect_roles(table(spark, d, "customer"), TABLE_WORDS))


_C8 = """SELECT '{c}' AS "column", CASE WHEN regexp_matches('{c}', '(^|_)(id|name|email|phone|nic|passport)(_|$)') OR (typeof(any_value({c})) IN ('VARCHAR', 'DATE') AND count(DISTINCT {c}) > 0.9 * count({c})) THEN 'Direct Identifier'
WHEN regexp_matches('{c}', '(^|_)(acctbal|totalprice|price|income|salary)$') THEN 'Sensitive' WHEN regexp_matches('{c}', '(^|_)(orderstatus|orderpriority|orderdate|nationkey|mktsegment)$') THEN 'Quasi-identifier' ELSE 'Non-sensitive' END AS role FROM orders"""


@query("c8_heuristic_roles", "SELECT *, CASE role WHEN 'Direct Identifier' THEN 'drop' WHEN 'Non-sensitive' THEN 'resample' ELSE 'synthesize' END AS action FROM (" + _each(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], _C8) + ")")
def c8(spark, d):
    return spark.createDataFrame(C.heuristic_roles(table(spark, d, "orders"), TABLE_WORDS), "column string, role string, action string")


_LEFT, _RIGHT = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, {"state": "CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE lower(o_orderstatus) END", "rank": "' ' || upper(o_orderpriority)", "year": "CAST(year(o_orderdate) AS VARCHAR)"}
_SETS = ", ".join(f"{n} AS (SELECT DISTINCT lower(trim({e})) AS v FROM orders WHERE {e} IS NOT NULL)" for side in (_LEFT, _RIGHT) for n, e in ((f"s_{k}", x) for k, x in side.items()))
_OVER = " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, (SELECT count(*) FROM s_{a} JOIN s_{b} USING (v)) / least((SELECT count(*) FROM s_{a}), (SELECT count(*) FROM s_{b}))::DOUBLE AS overlap" for a in _LEFT for b in _RIGHT)


@query("c15_mapping_suggestions", f"WITH {_SETS} SELECT * FROM ({_OVER}) WHERE overlap >= 0.6")
def c15(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "other").otherwise(F.lower("o_orderstatus"))
    right = o.select(state.alias("state"), F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("rank"), F.year("o_orderdate").cast("string").alias("year"))
    return C.suggest_mappings(o.select(*_LEFT), right, overlap=0.6)


@query("c17_strategy", "SELECT CASE WHEN r >= 0.6 THEN 'synthetic' WHEN r >= 0.3 THEN 'hybrid' ELSE 'anonymize' END AS strategy, CASE WHEN r >= 0.6 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level, round(r, 6) AS uniqueness_risk, 1.0::DOUBLE AS epsilon, 1 AS n_direct, 3 AS n_quasi, 0 AS n_sensitive FROM (SELECT (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_size, p_type HAVING count(*) = 1)) / (SELECT count(*) FROM part) AS r)")
def c17(spark, d):
    return C.recommend_strategy(part(spark, d), ["p_brand", "p_size", "p_type"], [], ["p_partkey"])


@query("c18_role_counts", f"WITH {_ROLES} SELECT role, count(*) AS n_columns, round(avg(round(confidence, 4)), 6)::DOUBLE AS avg_confidence FROM c1 GROUP BY role")
def c18(spark, d):
    return rounded(C.role_counts(c1(spark, d)))


@query(
    "p16_semantic_roles",
    """WITH u AS (SELECT count(DISTINCT c_mktsegment) / count(*) AS m, count(DISTINCT c_nationkey) / count(*) AS n, count(DISTINCT c_acctbal) / count(*) AS b, count(DISTINCT c_nationkey) AS nn, count(DISTINCT c_acctbal) AS nb FROM customer)
SELECT 'c_mktsegment' AS "column", round(CASE WHEN m BETWEEN 0.01 AND 0.6 THEN 0.35 ELSE 0 END + 0.45, 6)::DOUBLE AS qi_score, CASE WHEN m BETWEEN 0.01 AND 0.6 THEN 'QUASI_IDENTIFIER' ELSE 'NON_SENSITIVE' END AS role, 'coarse' AS granularity FROM u
UNION ALL SELECT 'c_nationkey', round(CASE WHEN n BETWEEN 0.02 AND 0.85 THEN 0.35 ELSE 0 END + 0.45, 6)::DOUBLE, CASE WHEN n BETWEEN 0.02 AND 0.85 THEN 'QUASI_IDENTIFIER' ELSE 'NON_SENSITIVE' END, 'coarse' FROM u
UNION ALL SELECT 'c_acctbal', round(CASE WHEN b BETWEEN 0.02 AND 0.85 THEN 0.35 ELSE 0 END + 0.1, 6)::DOUBLE, 'SENSITIVE', CASE WHEN nb <= 50 THEN 'coarse' WHEN nb <= 1000 THEN 'medium' ELSE 'fine' END FROM u""",
)
def p16(spark, d):
    return rounded(C.semantic_roles(table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal"), TABLE_WORDS))


_LIKE = """SELECT '{c}' AS "column", round(count(TRY_CAST(trim({c}) AS TIMESTAMP)) / count({c}), 6)::DOUBLE AS share, count(TRY_CAST(trim({c}) AS TIMESTAMP)) > 0.7 * count({c}) AS date_like
FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS half FROM orders)"""


@query("p28_date_like", _each(["day", "o_orderstatus", "half"], _LIKE))
def p28(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, d, "orders").select(day.alias("day"), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("none").alias("half"))
    return rounded(C.date_like(o, ["day", "o_orderstatus", "half"]))

