"""Anonymisation over customer, part and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anonymize as A
from ..operators import hierarchy as H
from ..operators import risk
from ..registry import query, rounded, table
from .risk import OC, QI, ordered


def U(tag: str, key: str, seed: int = 42) -> str:
    """The random number of a row in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}', CAST({key} AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0)"


def _rare(c: str, label: str, share: float = 0.05) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY {c}) < {share} * count(*) OVER () THEN '{label}' ELSE CAST({c} AS VARCHAR) END"


@query("a1_rare_categories", f"SELECT p_partkey, {_rare('p_brand', 'Other')} AS p_brand FROM part")
def a1(spark, d):
    return A.generalize_rare(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


def _bin(x: str, b: int, prefix: str, t: str) -> str:
    lo, hi = f"(SELECT CAST(min({x}) AS DOUBLE) FROM {t})", f"(SELECT CAST(max({x}) AS DOUBLE) FROM {t})"
    return f"'{prefix}' || CAST(least({b}, greatest(1, CAST(ceil(({x} - {lo}) / (({hi} - {lo}) / {b})) AS INTEGER))) - 1 AS VARCHAR)"


@query("a2_numeric_binning", f"SELECT p_partkey, {_bin('p_size', 5, 'Bin_', 'part')} AS p_size FROM part")
def a2(spark, d):
    return A.numeric_binning(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"])


@query("a3_custom_ranges", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN '1-10' WHEN p_size BETWEEN 10 AND 30 THEN '10-30' ELSE 'Other' END AS p_size FROM part")
def a3(spark, d):
    return A.custom_ranges(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", [(1, 10), (10, 30)])


@query("a4_suppress_rare", f"SELECT p_partkey, {_rare('p_brand', '*')} AS p_brand FROM part")
def a4(spark, d):
    return A.suppress_rare(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


@query("a5_levelled_numeric", f"SELECT p_partkey, {_bin('p_size', 7, 'Range_', 'part')} AS p_size FROM part")
def a5(spark, d):
    return A.generalize_level(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], 0.5)


@query(
    "a5_equal_frequency",
    """WITH v AS (SELECT p_size AS v, sum(count(*)) OVER (ORDER BY p_size) AS r, (SELECT count(*) FROM part) AS n FROM part GROUP BY 1),
q AS (SELECT greatest(3, CAST(floor(count(*) * 0.65) AS BIGINT)) AS q FROM v)
SELECT p_partkey, 'Level_' || CAST(CAST(greatest(1, (q * (r - 1) + n - 2) // (n - 1)) - 1 AS INTEGER) AS VARCHAR) AS p_size FROM part JOIN v ON p_size = v, q""",
)
def a5f(spark, d):
    return A.generalize_level(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size")), ["p_size"], 0.5)


_L = ["p_brand", "p_size", "p_type"]
_A6 = ", ".join(f"count(*) OVER (PARTITION BY {', '.join(x for x in _L if x != c)}) AS m{i}" for i, c in enumerate(_L))
_A6P = "CASE WHEN s >= 2 THEN -1 " + " ".join(f"WHEN m{i} >= 2 THEN {i}" for i in range(3)) + " ELSE -1 END"


@query(
    "a6_local_suppression",
    f"WITH x AS (SELECT p_partkey, p_brand, p_size, p_type, count(*) OVER (PARTITION BY {', '.join(_L)}) AS s, {_A6} FROM part), p AS (SELECT *, {_A6P} AS p FROM x) SELECT p_partkey, "
    + ", ".join(f"CASE WHEN p = {i} THEN '*' ELSE CAST({c} AS VARCHAR) END AS {c}" for i, c in enumerate(_L))
    + " FROM p",
)
def a6(spark, d):
    return A.local_suppression(table(spark, d, "part").select("p_partkey", *_L), _L)


def _generalised(src: str, keep: str, qi: list[str], numeric: list[str], level: float) -> str:
    """A5 in SQL: numbers in equal ranges, rare values of others together."""
    share = 0.2 - 0.15 * level
    cols = [f"{_bin(c, A.level_bins(level), 'Range_', src)} AS {c}" if c in numeric else f"CASE WHEN count(*) OVER (PARTITION BY {c}) < greatest(1, {share!r}::DOUBLE * count({c}) OVER ()) THEN 'Other' ELSE CAST({c} AS VARCHAR) END AS {c}" for c in qi]
    return f"SELECT {keep}, {', '.join(cols)} FROM {src}"


def _first_good(name: str, src: str, keep: str, qi: list[str], numeric: list[str], levels: tuple[float, ...], good, rest: str) -> str:
    """CTEs that end with ``name``: src as text or the first of its generalisations that is good, else ``rest`` (CTEs {name}_x from {name}_{n} on) of the last."""
    n = len(levels)
    ctes = [f"{name}_0 AS (SELECT {keep}, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in qi)} FROM {src})"]
    ctes += [f"{name}_{i} AS ({_generalised(src, keep, qi, numeric, g)})" for i, g in enumerate(levels, 1)]
    pick = " ".join(f"WHEN {good(f'{name}_{i}')} THEN {i}" for i in range(n + 1))
    ctes.append(f"{name}_pick AS (SELECT CASE {pick} ELSE {n + 1} END AS pick)")
    ctes.append(rest.replace("{last}", f"{name}_{n}").replace("{name}", name))
    cols = f"{keep}, {', '.join(qi)}"
    every = [f"SELECT {cols} FROM {name}_{i}, {name}_pick WHERE pick = {i}" for i in range(n + 1)] + [f"SELECT {cols} FROM {name}_x, {name}_pick WHERE pick = {n + 1}"]
    return ", ".join([*ctes, f"{name} AS ({' UNION ALL '.join(every)})"])


def _list(cols: list[str]) -> str:
    return ", ".join(cols)


def _star(cols: list[str], when: str) -> str:
    return ", ".join(f"CASE WHEN {when} THEN '*' ELSE {c} END AS {c}" for c in cols)


def _first_of(qi: list[str], value: str, good: str, otherwise: str) -> str:
    """CASE: -1 if all of the class is good, else the first QI without which it is, as a number."""
    return f"CASE WHEN {value} {good} THEN -1 " + " ".join(f"WHEN m{i} {good} THEN {i}" for i in range(len(qi))) + f" ELSE {otherwise} END"


def _k_anonymous(name: str, src: str, keep: str, qi: list[str], numeric: list[str], k: int, levels: tuple[float, ...] = (0.25, 0.5, 0.75)) -> str:
    less = ", ".join(f"count(*) OVER (PARTITION BY {_list([x for x in qi if x != c]) or '1'}) AS m{i}" for i, c in enumerate(qi))
    local = ", ".join(f"CASE WHEN p = {i} THEN '*' ELSE {c} END AS {c}" for i, c in enumerate(qi))
    rest = (
        f"{{name}}_s AS (SELECT *, count(*) OVER (PARTITION BY {_list(qi)}) AS s, {less} FROM {{last}}), {{name}}_l AS (SELECT {keep}, {local} FROM (SELECT *, {_first_of(qi, 's', f'>= {k}', '-1')} AS p FROM {{name}}_s)), "
        f"{{name}}_x AS (SELECT {keep}, {_star(qi, f's < {k}')} FROM (SELECT *, count(*) OVER (PARTITION BY {_list(qi)}) AS s FROM {{name}}_l))"
    )
    return _first_good(name, src, keep, qi, numeric, levels, lambda t: f"(SELECT min(n) FROM (SELECT count(*) AS n FROM {t} GROUP BY {_list(qi)})) >= {k}", rest)


@query("a7_k_anonymity", f"WITH {_k_anonymous('k', 'customer', 'c_custkey', QI, ['c_nationkey'], 8)} SELECT c_custkey, c_nationkey, c_mktsegment FROM k")
def a7(spark, d):
    return A.k_anonymity(table(spark, d, "customer").select("c_custkey", *QI), QI, 8)


def _distinct(v: str, qi: list[str], t: str, name: str) -> str:
    """A table of the number of distinct v by some QIs."""
    return f"(SELECT {_list(qi)}, count(DISTINCT {v}) AS {name} FROM {t} GROUP BY {_list(qi)})" if qi else f"(SELECT count(DISTINCT {v}) AS {name} FROM {t})"


def _l_diverse(name: str, src: str, keep: str, qi: list[str], numeric: list[str], v: str, l: int) -> str:  # noqa: E741
    joins = f"{{last}} JOIN {_distinct(v, qi, '{last}', 'd')} USING ({_list(qi)})"
    for i, c in enumerate(qi):
        left = [x for x in qi if x != c]
        joins += f" JOIN {_distinct(v, left, '{last}', f'm{i}')} USING ({_list(left)})" if left else f" CROSS JOIN {_distinct(v, left, '{last}', f'm{i}')}"
    some = ", ".join(f"CASE WHEN p = {i} OR p = {len(qi)} THEN '*' ELSE {c} END AS {c}" for i, c in enumerate(qi))
    rest = (
        f"{{name}}_s AS (SELECT {keep}, {some} FROM (SELECT *, {_first_of(qi, 'd', f'>= {l}', str(len(qi)))} AS p FROM {joins})), "
        f"{{name}}_x AS (SELECT {keep}, {_star(qi, f'd < {l}')} FROM {{name}}_s JOIN {_distinct(v, qi, '{name}_s', 'd')} USING ({_list(qi)}))"
    )
    return _first_good(name, src, keep, qi, numeric, (0.3, 0.5, 0.7), lambda t: f"(SELECT min(d) FROM {_distinct(v, qi, t, 'd')}) >= {l}", rest)


def _tvd(v: str, qi: list[str], t: str) -> str:
    q = _list(qi)
    return (
        f"(SELECT {q}, 0.5 * sum(abs(coalesce(c, 0) / s - g)) AS d FROM (SELECT {q}, count(*) AS s FROM {t} GROUP BY {q}) CROSS JOIN (SELECT {v}, count(*) / (SELECT count(*) FROM {t}) AS g FROM {t} GROUP BY {v}) "
        f"LEFT JOIN (SELECT {q}, {v}, count(*) AS c FROM {t} GROUP BY {q}, {v}) USING ({q}, {v}) GROUP BY {q})"
    )


def _t_close(name: str, src: str, keep: str, qi: list[str], numeric: list[str], v: str, t: float) -> str:
    rest = f"{{name}}_x AS (SELECT {keep}, {_star(qi, f'd > {t} + 1e-12')} FROM {{last}} JOIN {_tvd(v, qi, '{last}')} USING ({_list(qi)}))"
    return _first_good(name, src, keep, qi, numeric, (0.3, 0.5, 0.7), lambda x: f"(SELECT max(d) FROM {_tvd(v, qi, x)}) <= {t} + 1e-12", rest)


_A8 = ["o_orderstatus", "c_nationkey", "o_custkey"]
_KEEP = "o_orderkey, o_orderpriority"


@query("a7_k_anonymity_by_suppression", f"WITH {_k_anonymous('k', 'part', 'p_partkey', _L, ['p_size'], 5)} SELECT * FROM k")
def a7s(spark, d):
    return A.k_anonymity(table(spark, d, "part").select("p_partkey", *_L), _L, 5)


@query("a8_l_diversity", f"WITH oc AS ({OC}), {_l_diverse('l', 'oc', _KEEP, _A8, _A8[1:], 'o_orderpriority', 4)} SELECT * FROM l")
def a8(spark, d):
    return A.l_diversity(ordered(spark, d).select("o_orderkey", *_A8, "o_orderpriority"), _A8, "o_orderpriority", 4)


@query("a9_t_closeness", f"WITH oc AS ({OC}), {_t_close('t', 'oc', _KEEP, QI, QI[:1], 'o_orderpriority', 0.05)} SELECT * FROM t")
def a9(spark, d):
    return A.t_closeness(ordered(spark, d).select("o_orderkey", *QI, "o_orderpriority"), QI, "o_orderpriority", 0.05)


@query("a10_suppression", "WITH x AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS s FROM customer) SELECT c_custkey, CASE WHEN s < 12 THEN '*' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey, CASE WHEN s < 12 THEN '*' ELSE c_mktsegment END AS c_mktsegment FROM x")
def a10(spark, d):
    return A.suppress_small(table(spark, d, "customer").select("c_custkey", *QI), QI, 12)


@query("a11_microaggregation", "WITH x AS (SELECT c_custkey, c_acctbal, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) // 5 AS g FROM customer) SELECT c_custkey, round(avg(CAST(c_acctbal AS DOUBLE)) OVER (PARTITION BY g), 6) AS c_acctbal FROM x")
def a11(spark, d):
    return rounded(A.microaggregate(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 5, "c_custkey"))


@query(
    "a12_pram",
    f"""WITH v AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS v FROM customer),
x AS (SELECT c_custkey, c_mktsegment, v, len(v) AS m, list_position(v, c_mktsegment) AS p, {U('pram-keep-c_mktsegment', 'c_custkey')} AS u, {U('pram-pick-c_mktsegment', 'c_custkey')} AS w FROM customer, v)
SELECT c_custkey, CASE WHEN u < 0.9 THEN c_mktsegment ELSE v[CAST((p - 1 + floor(w * (m - 1)) + 1) % m + 1 AS INTEGER)] END AS c_mktsegment FROM x""",
)
def a12(spark, d):
    return A.pram(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 0.1)


@query(
    "a13_pram_matrix",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN u < 0.7 THEN 'F' ELSE 'O' END WHEN o_orderstatus = 'O' THEN CASE WHEN u < 0.2 THEN 'F' WHEN u < 0.9 THEN 'O' ELSE 'P' END ELSE o_orderstatus END AS o_orderstatus
FROM (SELECT *, {U('pram-matrix-o_orderstatus', 'o_orderkey')} AS u FROM orders)""",
)
def a13(spark, d):
    matrix = {"F": {"F": 0.7, "O": 0.3}, "O": {"F": 0.2, "O": 0.7, "P": 0.1}}
    return A.pram_matrix(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", matrix)


@query(
    "a14_hybrid",
    f"WITH oc AS ({OC}), g AS ({_generalised('oc', _KEEP, QI, QI[:1], 0.5)}), {_k_anonymous('k', 'g', _KEEP, QI, [], 8)}, {_l_diverse('l', 'k', _KEEP, QI, [], 'o_orderpriority', 3)}, {_t_close('t', 'l', _KEEP, QI, [], 'o_orderpriority', 0.2)} SELECT * FROM t",
)
def a14(spark, d):
    return A.hybrid(ordered(spark, d).select("o_orderkey", *QI, "o_orderpriority"), QI, ["o_orderpriority"], 8, 3, 0.2)


@query(
    "a15_psu_regions",
    "WITH c AS (SELECT c_nationkey AS v, count(*) AS c FROM customer GROUP BY 1), b AS (SELECT v, 'REGION_' || CAST(dense_rank() OVER (ORDER BY v) - 1 AS VARCHAR) AS l FROM c WHERE c >= 60) SELECT c_custkey, coalesce(l, 'REGION_OTHER') AS c_nationkey FROM customer LEFT JOIN b ON v = c_nationkey",
)
def a15(spark, d):
    return A.psu(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", least=60)


@query(
    "a16_psu_random",
    f"""WITH c AS (SELECT c_nationkey AS v, count(*) AS c FROM customer GROUP BY 1), g AS (SELECT *, CAST(floor({U('psu-c_nationkey', 'v')} * (SELECT greatest(1, count(*) // 100) FROM customer)) AS INTEGER) + 1 AS g FROM c),
s AS (SELECT *, sum(c) OVER (PARTITION BY g) AS t FROM g) SELECT c_custkey, CASE WHEN t >= 100 THEN 'PSU_RECODED_' || CAST(g AS VARCHAR) ELSE 'PSU_RECODED_OTHER' END AS c_nationkey FROM customer JOIN s ON v = c_nationkey""",
)
def a16(spark, d):
    return A.psu(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "random_recode", least=100)


@query("a18_age_bands", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS l0, (p_size // 5 * 5) || '-' || (p_size // 5 * 5 + 4) AS l1, (p_size // 10 * 10) || '-' || (p_size // 10 * 10 + 9) AS l2, (p_size // 20 * 20) || '-' || (p_size // 20 * 20 + 19) AS l3, (p_size // 50 * 50) || '-' || (p_size // 50 * 50 + 49) AS l4, '*' AS l5 FROM part")
def a18(spark, d):
    return table(spark, d, "part").select("p_partkey", *(H.age_label(F.col("p_size"), n).alias(f"l{n}") for n in range(6)))


@query(
    "a18_date_bands",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || ' ' || CASE WHEN day(o_orderdate) <= 7 THEN '1-7' WHEN day(o_orderdate) <= 14 THEN '8-14' WHEN day(o_orderdate) <= 21 THEN '15-21' ELSE '22-31' END AS l1, strftime(o_orderdate, '%Y-%m') AS l2,
 strftime(o_orderdate, '%Y') AS l3, (year(o_orderdate) // 10 * 10) || 's' AS l4, (year(o_orderdate) // 100 * 100) || 's' AS l5 FROM orders""",
)
def a18d(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(H.date_label(F.col("o_orderdate"), n).alias(f"l{n}") for n in range(1, 6)))


@query("a18_zip_masks", "WITH z AS (SELECT c_custkey, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS z FROM customer) SELECT c_custkey, z[1:3] || '**' AS l1, z[1:2] || '***' AS l2, z[1:1] || '****' AS l3, z[1:1] AS l4 FROM z")
def a18z(spark, d):
    z = F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    return table(spark, d, "customer").select("c_custkey", *(H.zipcode_label(z, n).alias(f"l{n}") for n in range(1, 5)))


@query("a18_geography", "SELECT n_nationkey, r_name AS l1, 'World' AS l2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def a18g(spark, d):
    # The nations' own hierarchy: nation, region, world.
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions: dict[str, list[str]] = {}
    for r in both.select("n_name", "r_name").collect():
        regions.setdefault(r["r_name"], []).append(r["n_name"])
    h = H.Hierarchy("n_name", levels=[regions, {"World": list(regions)}])
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("l1"), F.col("n_name").alias("l2"))
    return h.column(h.column(nation, "l1", 1), "l2", 2)


@query("a21_numeric_hierarchy", "WITH x AS (SELECT p_partkey, least(7, greatest(0, CAST(floor((p_size - 1) / 6.125) AS INTEGER))) AS i, least(3, greatest(0, CAST(floor((p_size - 1) / 12.25) AS INTEGER))) AS j FROM part) SELECT p_partkey, CAST(1 + i * 6.125::DOUBLE AS VARCHAR) || '-' || CAST(1 + (i + 1) * 6.125::DOUBLE AS VARCHAR) AS l1, CAST(1 + j * 12.25::DOUBLE AS VARCHAR) || '-' || CAST(1 + (j + 1) * 12.25::DOUBLE AS VARCHAR) AS l2 FROM x")
def a21(spark, d):
    h = H.numeric_hierarchy("p_size", 1, 50, 3)
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("l1"), F.col("p_size").alias("l2"))
    return h.column(h.column(part, "l1", 1), "l2", 2)


@query(
    "a24_value_partitions",
    """WITH b AS (SELECT p_partkey, p_brand, p_size, CAST(p_brand AS VARCHAR) AS x, (p_size // 10 * 10) || '-' || (p_size // 10 * 10 + 9) AS y, '0' AS p FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY p, x) AS c FROM b),
l AS (SELECT p, arg_max(x, (-c, x)) FILTER (c >= 20) AS last, count(*) FILTER (c < 20) AS rest FROM c GROUP BY p),
d AS (SELECT c.* EXCLUDE (p, c), CASE WHEN c >= 20 AND NOT (rest BETWEEN 1 AND 19 AND x = last) THEN p || '/0:=' || x ELSE p END AS p FROM c JOIN l USING (p)),
e AS (SELECT *, count(*) OVER (PARTITION BY p, y) AS c FROM d),
m AS (SELECT p, arg_max(y, (-c, y)) FILTER (c >= 20) AS last, count(*) FILTER (c < 20) AS rest FROM e GROUP BY p)
SELECT p_partkey, p_brand, p_size, CASE WHEN c >= 20 AND NOT (rest BETWEEN 1 AND 19 AND y = last) THEN p || '/1:=' || y ELSE p END AS partition FROM e JOIN m USING (p)""",
)
def a24_value(spark, d):
    m = H.HierarchyManager()
    m.add(H.categorical_hierarchy("p_brand", {}))
    m.add(H.template("p_size", "age"))
    m.set_level("p_size", 2)
    return H.value_partitions(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), m, ["p_brand", "p_size"], 20)


@query("a24_mondrian")
def a24(spark, d):
    return H.mondrian(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], 20)


@query(
    "a27_k_anonymity_with_hierarchy",
    "WITH l AS (SELECT 1 AS n, 5 AS w UNION ALL SELECT 2, 10 UNION ALL SELECT 3, 20 UNION ALL SELECT 4, 50), s AS (SELECT n, w, min(c) AS m FROM (SELECT n, w, p_brand, p_size // w AS b, count(*) AS c FROM part, l GROUP BY ALL) GROUP BY ALL), p AS (SELECT w FROM s WHERE m >= 8 ORDER BY n LIMIT 1) SELECT p_partkey, p_brand, (p_size // w * w) || '-' || (p_size // w * w + w - 1) AS p_size FROM part, p",
)
def a27(spark, d):
    m = H.HierarchyManager()
    m.add(H.template("p_size", "age"))
    m.add(H.categorical_hierarchy("p_brand", {}))
    m.by_name["p_brand"].levels += [{}] * 5
    out, _ = m.k_anonymity(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], 8)
    return out


@query("a29_sensitive_transform", "WITH t AS (SELECT c_mktsegment AS v FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) SELECT c_custkey, CASE WHEN c_mktsegment IN (SELECT v FROM t) THEN c_mktsegment ELSE '[OTHER]' END AS c_mktsegment FROM customer")
def a29(spark, d):
    return A.sensitive_transform(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


_A30 = """WITH s AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS n, c_mktsegment AS m, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS s, c_name FROM customer), a AS (SELECT *, CASE WHEN s < 12 THEN '*' ELSE n END AS n2, CASE WHEN s < 12 THEN '*' ELSE m END AS m2 FROM s)
SELECT 'c_name' AS "column", count(DISTINCT c_name) AS unique_before, 1::BIGINT AS unique_after, 0::BIGINT AS nulls_before, 0::BIGINT AS nulls_after, 0::BIGINT AS suppressed, 0::BIGINT AS generalized, count(*) AS changed FROM a
UNION ALL SELECT 'c_nationkey', count(DISTINCT n), count(DISTINCT n2), 0, 0, count(*) FILTER (n2 = '*'), 0, count(*) FILTER (n <> n2) FROM a UNION ALL SELECT 'c_mktsegment', count(DISTINCT m), count(DISTINCT m2), 0, 0, count(*) FILTER (m2 = '*'), 0, count(*) FILTER (m <> m2) FROM a"""


@query("a30_comprehensive_log", _A30)
def a30(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", *QI)
    return A.comprehensive(c, A.suppress_small(c, QI, 12), "c_custkey", ["c_name"], QI, [])[1]


@query("r24_suppression_ratio", "SELECT round(count(*) FILTER (s < 12) / count(*), 6) AS suppression_ratio FROM (SELECT count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS s FROM customer)")
def r24(spark, d):
    return rounded(risk.suppression_ratio(a10(spark, d), QI))


@query(
    "r25_modified_rows",
    "WITH s AS (SELECT c_nationkey AS n, c_mktsegment AS m, count(*) AS s FROM customer GROUP BY ALL) SELECT CAST(coalesce(sum(s) FILTER (s < 12), 0) AS BIGINT) AS modified_rows, count(*) AS combinations_before, count(*) FILTER (s >= 12) + max(CASE WHEN s < 12 THEN 1 ELSE 0 END) AS combinations_after, round(100.0 * (1 - (count(*) FILTER (s >= 12) + max(CASE WHEN s < 12 THEN 1 ELSE 0 END)) / count(*)), 2) AS combination_reduction_pct FROM s",
)
def r25(spark, d):
    c = table(spark, d, "customer").select("c_custkey", *QI)
    return risk.modified_rows(c, a10(spark, d), "c_custkey", QI)


@query("sdc_top_bottom_coding", "WITH q AS (SELECT quantile_cont(CAST(c_acctbal AS DOUBLE), 0.05) AS lo, quantile_cont(CAST(c_acctbal AS DOUBLE), 0.95) AS hi FROM customer) SELECT c_custkey, round(least(greatest(CAST(c_acctbal AS DOUBLE), lo), hi), 6) AS c_acctbal FROM customer, q")
def top_bottom(spark, d):
    return rounded(A.top_bottom(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query(
    "sdc_perturbation",
    f"WITH s AS (SELECT stddev_samp(CAST(c_acctbal AS DOUBLE)) AS sd FROM customer), x AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v, sd, (({U('noise-c_acctbal', 'c_custkey')} * 4294967296.0) + 0.5) / 4294967296.0 - 0.5 AS u FROM customer, s) SELECT c_custkey, round(v - sign(u) * sd * 0.1 * ln(1 - 2 * abs(u)), 4) AS c_acctbal FROM x",
)
def perturbation(spark, d):
    return rounded(A.perturb(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), ["c_acctbal"], "c_custkey"), 4)


@query(
    "sdc_data_swapping",
    f"WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY {U('swap-to', 'c_custkey')}, c_custkey) AS r FROM customer), b AS (SELECT c_mktsegment, row_number() OVER (ORDER BY {U('swap-from', 'c_custkey')}, c_custkey) AS r FROM customer) SELECT c_custkey, c_mktsegment FROM a JOIN b USING (r)",
)
def swapping(spark, d):
    return A.swap(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey")


@query("sdc_hashing", "SELECT c_custkey, sha256('salt' || c_name) AS c_name FROM customer")
def hashing(spark, d):
    return A.hash_columns(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name"], "salt")


@query("sdc_sampling", f"SELECT c_custkey FROM customer WHERE {U('sample', 'c_custkey')} < 0.1")
def sampling(spark, d):
    return A.sample(table(spark, d, "customer"), "c_custkey").select("c_custkey")


@query("sdc_household_aggregation", "SELECT o_custkey, count(*) AS household_size, round(avg(CAST(o_totalprice AS DOUBLE)), 6) AS o_totalprice FROM orders GROUP BY 1")
def household(spark, d):
    return rounded(A.household(table(spark, d, "orders"), "o_custkey", ["o_totalprice"]))
