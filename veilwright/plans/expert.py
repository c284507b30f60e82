"""The rule base on a risk profile, recommendations, pipelines of steps, and execution with validation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from itertools import combinations, product
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..operators import anonymize, profile, risk
from ..operators.anonymize import TRANSFORMS, is_numeric
from ..operators.classify import KIND_WORDS, tokens

SEVERITY = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}


@dataclass
class Rule:
    """``condition`` holds on a profile (a dict); an absent key is None."""

    name: str
    condition: Callable[[dict], bool]
    methods: list[str]
    severity: str


def _n(p: dict, key: str, default: float = 0) -> float:
    v = p.get(key)
    return default if v is None else v


def rule_base(k: int = 5) -> list[Rule]:
    """The 22 rules."""
    return [
        Rule("High Cardinality in QI", lambda p: _n(p, "unique_ratio") > 0.9, ["generalization", "suppression"], "High"),
        Rule("Continuous Numeric QIs", lambda p: _n(p, "num_continuous_qi") > 0, ["generalization", "microaggregation", "top_bottom_coding"], "High"),
        Rule("Low Diversity in Sensitive Attribute", lambda p: _n(p, "sensitive_distinct", 99) < 3, ["l_diversity", "t_closeness", "differential_privacy"], "High"),
        Rule("Skewed Sensitive Distribution", lambda p: _n(p, "sensitive_max_freq") > 0.5, ["t_closeness", "differential_privacy"], "High"),
        Rule("Small Equivalence Classes", lambda p: _n(p, "min_group_size", 99) < _n(p, "k_threshold", k), ["k_anonymity", "microaggregation", "generalization"], "High"),
        Rule("Rare QI Combinations", lambda p: _n(p, "rare_combinations_ratio") > 0.1, ["suppression", "generalization", "microaggregation"], "High"),
        Rule("High QI Correlation", lambda p: _n(p, "max_qi_correlation") > 0.7, ["feature_selection", "generalization"], "Medium"),
        Rule("High Dimensionality", lambda p: _n(p, "num_qi") > 5, ["feature_selection", "dimensionality_reduction"], "Medium"),
        Rule("Numeric QI Outliers", lambda p: bool(p.get("outliers_detected")), ["microaggregation", "top_bottom_coding", "generalization"], "Medium"),
        Rule("PSU Detected at Release Level", lambda p: bool(p.get("has_psu") and p.get("psu_at_release")), ["psu_aggregation", "geo_generalization"], "Critical"),
        Rule("Geographic Precision Risk", lambda p: bool(p.get("has_geographic_qi")) and p.get("geographic_precision") == "exact", ["geo_generalization", "spatial_cloaking"], "High"),
        Rule("Household Hierarchical Data", lambda p: bool(p.get("is_household_data")), ["household_aggregation", "psu_aggregation"], "Medium"),
        Rule("Temporal Patterns Detected", lambda p: bool(p.get("has_temporal_qi") and p.get("temporal_patterns")), ["temporal_generalization", "perturbation"], "Medium"),
        Rule("Unique Records", lambda p: _n(p, "unique_records_ratio") > 0.05, ["suppression", "generalization", "data_swapping"], "High"),
        Rule("Differential Privacy Required", lambda p: bool(p.get("dp_required")), ["differential_privacy"], "High"),
        Rule("Synthetic Data Appropriate", lambda p: bool(p.get("synthetic_suitable")), ["synthetic_data"], "Medium"),
        Rule("Multiple High-Risk Conditions", lambda p: _n(p, "num_high_risk") >= 3, ["hybrid"], "Critical"),
        Rule("PRAM Suitable", lambda p: (_n(p, "categorical_risk_score") > 0.3 or bool(p.get("has_categorical_qi"))) and not p.get("dp_required"), ["pram", "generalization", "suppression"], "High"),
        Rule("Local Suppression Opportunity", lambda p: _n(p, "rare_values_ratio") > 0.05, ["local_suppression", "suppression"], "High"),
        Rule("Bucketization Recommended", lambda p: _n(p, "num_continuous_qi") > 0 and bool(p.get("high_cardinality_numeric")), ["bucketization", "generalization"], "Medium"),
        Rule("Sampling Suitable", lambda p: _n(p, "dataset_size") > 100_000 and bool(p.get("sampling_allowed")), ["sampling"], "Medium"),
        Rule("Identifiers Present", lambda p: bool(p.get("identifier_present")), ["hashing", "attribute_suppression"], "High"),
    ]


def evaluate(p: dict, rules: list[Rule] | None = None) -> list[Rule]:
    """X2."""
    return [r for r in rules or rule_base() if r.condition(p)]


def full_profile(df: DataFrame, qi: list[str], sensitive: str | None = None, **settings) -> dict:
    """The profile that the rules read, from a handful of aggregates."""
    if not qi:
        raise ValueError("no quasi-identifiers")
    missing = [c for c in [*qi, *([sensitive] if sensitive else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    p: dict = {"problems": [], **settings}
    r = risk.risk_profile(df, qi, sensitive or qi[0]).first()
    p |= r.asDict() if r else {"n": 0}
    p["dataset_size"], p["num_qi"] = p["n"], len(qi)
    num = [c for c in qi if is_numeric(df, c)]
    cat = [c for c in qi if c not in num]
    uniq = {r["column"]: (r["n_unique"], r["unique_ratio"]) for r in risk.column_uniqueness(df, qi).collect()}
    p["unique_ratio"] = max((u or 0.0 for _, u in uniq.values()), default=0.0)
    p["num_continuous_qi"] = sum(uniq[c][0] > 10 for c in num)
    p["high_cardinality_numeric"] = any((uniq[c][1] or 0) > 0.5 for c in num)
    p["max_qi_correlation"] = max((abs(r["corr"]) for r in profile.correlations(df, num).collect() if r["corr"] is not None), default=0.0) if len(num) > 1 else 0.0
    p["outliers_detected"] = any(r["outliers_detected"] for r in profile.z_outliers(df, num).collect()) if num else False
    p["mean_entropy"] = profile.entropy(df, qi).agg(F.avg("entropy")).first()[0] or 0.0
    p["rare_values_ratio"] = risk.rare_values_ratio(df, qi).first()[0]
    p["categorical_risk_score"] = risk.categorical_risk(df, cat).agg(F.max("risk_score")).first()[0] if cat else 0.0
    p["has_categorical_qi"] = bool(cat)
    if sensitive:
        s = profile.value_counts(df, [sensitive]).agg(F.count(F.lit(1)).alias("u"), F.max("count").alias("m"), F.sum("count").alias("n")).first()
        p["sensitive_distinct"], p["sensitive_max_freq"] = s["u"], (s["m"] or 0) / max(1, s["n"] or 0)
    else:
        p["problems"].append("no sensitive attribute")
        for k in ("attribute_disclosure_risk", "sensitive_distinct_min"):
            p.pop(k, None)
    words = {c: tokens(c) for c in qi}
    p["has_geographic_qi"] = any(w & KIND_WORDS["geography"] for w in words.values())
    p["geographic_precision"] = "exact" if any(w & {"latitude", "longitude", "address", "coordinates"} for w in words.values()) else "area"
    p["has_temporal_qi"] = any(w & {"date", "time", "year", "month"} for w in words.values())
    p["has_psu"] = psu_column(df, qi) is not None
    p["psu_at_release"] = p["has_psu"] and any("psu" in w for w in words.values())
    p["is_household_data"] = any(tokens(c) & {"household", "hh", "family"} for c in df.columns)
    p["identifier_present"] = any(tokens(c) & {"id", "name", "ssn", "email", "phone", "address", "passport"} for c in df.columns)
    p["synthetic_suitable"] = p["n"] >= 1000 and len(qi) > 10
    if (p.get("min_group_size") or 99) < 5:
        p["problems"].append("classes of fewer than 5 records")
    if p.get("unique_records_ratio", 0) > 0.05:
        p["problems"].append("many distinct combinations")
    p["num_high_risk"] = sum(r.severity in ("High", "Critical") for r in evaluate(p))
    return p


def psu_column(df: DataFrame, qi: list[str]) -> str | None:
    """X7."""
    for c in df.columns:
        if tokens(c) & {"psu", "cluster", "stratum", "enumeration"}:
            return c
    near = [c for c in qi if tokens(c) & {"id", "code", "number"}]
    if not near:
        return None
    return next((r["column"] for r in risk.column_uniqueness(df, near).collect() if (r["unique_ratio"] or 0) > 0.8), None)


# The catalogue, with the parameters that each method takes.
METHODS = {
    "generalization": {"label": "Generalization", "params": {"level": 0.5}}, "suppression": {"label": "Record suppression", "params": {"threshold": 5}}, "local_suppression": {"label": "Local suppression", "params": {"k": 2}},
    "k_anonymity": {"label": "k-anonymity", "params": {"k": 5}}, "l_diversity": {"label": "l-diversity", "params": {"l": 2}}, "t_closeness": {"label": "t-closeness", "params": {"t": 0.3}}, "hybrid": {"label": "Hybrid", "params": {"k": 5, "l": 2, "t": 0.3}},
    "microaggregation": {"label": "Microaggregation", "params": {"group": 5}}, "pram": {"label": "Post-randomisation", "params": {"rate": 0.1}}, "top_bottom_coding": {"label": "Top and bottom coding", "params": {"low": 5, "high": 95}},
    "perturbation": {"label": "Noise", "params": {"scale": 0.1}}, "data_swapping": {"label": "Data swapping", "params": {}}, "bucketization": {"label": "Bucketization", "params": {"bins": 5}}, "hashing": {"label": "Hashing", "params": {}},
    "attribute_suppression": {"label": "Attribute suppression", "params": {}}, "psu_aggregation": {"label": "PSU aggregation", "params": {"least": 5}}, "geo_generalization": {"label": "Geographic generalization", "params": {"level": 1}}, "spatial_cloaking": {"label": "Spatial cloaking", "params": {"cell": 0.1}},
    "household_aggregation": {"label": "Household aggregation", "params": {}}, "temporal_generalization": {"label": "Temporal generalization", "params": {"unit": "month"}}, "feature_selection": {"label": "Feature selection", "params": {"limit": 0.95}},
    "dimensionality_reduction": {"label": "Dimensionality reduction", "params": {"k": 2}}, "sampling": {"label": "Sampling", "params": {"fraction": 0.1}}, "differential_privacy": {"label": "Differential privacy", "params": {"epsilon": 1.0}}, "synthetic_data": {"label": "Synthetic data", "params": {"epsilon": 1.0}},
}


def confidence(method: str, p: dict) -> float:
    """X5."""
    if method == "k_anonymity":
        return 0.95 if _n(p, "min_group_size", 99) < 3 else 0.8
    if method == "pram":
        return 1.0 if _n(p, "categorical_risk_score") > 0.5 else 0.95
    return {"differential_privacy": 1.0, "synthetic_data": 0.9, "psu_aggregation": 0.95}.get(method, 0.8)


@dataclass
class RecommendationSet:
    primary: str | None
    secondary: list[str]
    methods: dict[str, float]
    triggered: list[str]
    severity: str | None
    notes: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


def recommend(p: dict, rules: list[Rule] | None = None) -> RecommendationSet:
    """Methods by frequency + 10 confidence; the primary one among those of .95 and more if there are such."""
    hit = evaluate(p, rules)
    freq = Counter(m for r in hit for m in r.methods)
    score = {m: n + 10 * confidence(m, p) for m, n in freq.items()}
    order = sorted(score, key=lambda m: (-score[m], m))
    sure = [m for m in order if confidence(m, p) >= 0.95]
    first = (sure or order or [None])[0]
    rest = [m for m in order if m != first]
    top = max((r.severity for r in hit), key=SEVERITY.get, default=None)
    notes = [f"{len(hit)} rules hold"] + (["several high risks at once"] if _n(p, "num_high_risk") >= 3 else [])
    return RecommendationSet(first, rest[:2], {m: round(score[m], 4) for m in order}, [r.name for r in hit], top, notes)


@dataclass
class Step:
    method: str
    columns: list[str]
    parameters: dict = field(default_factory=dict)


@dataclass
class Pipeline:
    name: str
    steps: list[Step]

    def to_dict(self) -> dict:
        """U7."""
        return asdict(self)

    def apply(self, df: DataFrame, **common) -> DataFrame:
        """Each step through ``DataFrame.transform``; ``common`` fills parameters such as key and sensitive that a step's method takes."""
        import inspect

        for s in self.steps:
            fn = TRANSFORMS[s.method]
            takes = list(inspect.signature(fn).parameters)
            kw = {k: v for k, v in {**common, **s.parameters}.items() if k in takes[2:]}
            df = materialise(df.transform(fn, s.columns, **kw), f"step-{s.method}")
        return df


def _grid(rows: int) -> list[dict]:
    """Parameters to vary: k up to a tenth of the rows and 20 (three of them), l, t and level."""
    most = max(2, min(20, rows // 10))
    ks = sorted(k for k in {2, 3, 5, 10, most // 2, most} if 2 <= k <= most)[:3]
    return [dict(zip(("k", "l", "t", "level"), x, strict=True)) for x in product(ks, (2, 3), (0.1, 0.2, 0.3), (0.3, 0.5, 0.7))]


#: What a step of a method takes from the parameters; methods that protect sensitive columns say so.
_TAKES = {"k_anonymity": ("k",), "l_diversity": ("l",), "t_closeness": ("t",), "hybrid": ("k", "l", "t", "level"), "generalization": ("level",), "local_suppression": ("k",)}
_FIXED = {"microaggregation": {"group": 3}, "pram": {"rate": 0.05, "seed": 42}, "suppression": {"threshold": 5}, "psu_aggregation": {"least": 5}}


def _step(method: str, qi: list[str], g: dict, **more) -> Step:
    return Step(method, list(qi), {k: g[k] for k in _TAKES.get(method, ())} | dict(_FIXED.get(method, {})) | more)


def _single(method: str, qi: list[str], g: dict) -> list[Step]:
    """A method with what it builds on: diversity on generalisation, closeness on both."""
    before = {"l_diversity": ("generalization", "k_anonymity"), "t_closeness": ("generalization", "k_anonymity")}.get(method, ())
    return [_step(m, qi, g) for m in (*before, method)]


def rule_steps(rule: Rule, qi: list[str], g: dict) -> list[Step]:
    """The steps that a rule asks for: its own first method that can run, coarse for high cardinality, and k-anonymity or diversity after it where the rule is about classes or sensitive values."""
    words = tokens(rule.name)
    first = next((m for m in rule.methods if m in TRANSFORMS and m not in ("hybrid", "synthetic_data")), "k_anonymity")
    if "psu" in words or "household" in words:
        return [_step("psu_aggregation", qi, g), _step("k_anonymity", qi, g)]
    if "cardinality" in words:
        return [_step("generalization", qi, g, level=0.8), _step("suppression", qi, g)]
    if words & {"sensitive", "diversity"}:
        return [_step("k_anonymity", qi, g), _step("l_diversity", qi, g)]
    if words & {"rare", "unique"}:
        return [_step("suppression", qi, g), _step("k_anonymity", qi, g)]
    return [_step(first, qi, g)] + ([_step("k_anonymity", qi, g)] if first != "k_anonymity" else [])


def generate_pipelines(qi: list[str], recommended: list[str], n: int = 5, triggered: list[str] | None = None, rows: int = 1000, rules: list[Rule] | None = None) -> list[Pipeline]:
    """Exactly ``n`` pipelines, no two with the same steps.

    First single methods, then pairs of them on a generalisation, then what the
    ``triggered`` rules ask for, all with the first settings of a grid; then the
    same with the other settings; and where that is not enough, k is raised from
    pipeline to pipeline. Without a method that can run, k-anonymity is taken.
    Steps are built anew each time, so that no two pipelines share one.
    """
    grid = _grid(rows)
    known = list(dict.fromkeys(m for m in recommended if m in TRANSFORMS and m not in ("hybrid", "synthetic_data"))) or ["k_anonymity"]
    fired = [r for name in dict.fromkeys(triggered or []) for r in rules or rule_base() if r.name == name]
    kinds: list[tuple[str, Callable[[dict], list[Step]]]] = [(m, lambda g, m=m: _single(m, qi, g)) for m in known]
    kinds += [(f"{a}+{b}", lambda g, a=a, b=b: [_step(m, qi, g) for m in dict.fromkeys(("generalization", a, b))]) for a, b in combinations(known, 2)]
    kinds += [(r.name, lambda g, r=r: rule_steps(r, qi, g)) for r in fired]
    out: list[Pipeline] = []
    seen: set[str] = set()

    def add(name: str, steps: list[Step]) -> None:
        key = repr([asdict(s) for s in steps])
        if key not in seen and len(out) < n:
            seen.add(key)
            out.append(Pipeline(name, steps))

    for i, g in enumerate(grid):
        for name, make in kinds:
            add(name if i == 0 else f"{name} {i + 1}", make(g))
    k = max(g["k"] for g in grid)
    while len(out) < n:
        k += 1
        for name, make in [*kinds, ("k_anonymity", lambda g: _single("k_anonymity", qi, g))]:
            add(f"{name} k={k}", make(grid[0] | {"k": k}))
    return out


@dataclass
class Execution:
    data: DataFrame
    success: bool
    iterations: int
    checks: list[dict]
    suppression_ratio: float
    parameters: dict


def all_checks(df: DataFrame, qi: list[str], sensitive: list[str], k: int, l: int, t: float, with_t: bool = True) -> list[dict]:  # noqa: E741
    """R21 of all sensitive columns: k and every column's l from one aggregate over the classes, and each column's t; a row a constraint with its column."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(qi)]
    classes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"), *(F.count_distinct(c).alias(f"_l{i}") for i, c in enumerate(sensitive)))
    needs = [("_s", k), *((f"_l{i}", l) for i in range(len(sensitive)))]
    row = classes.agg(F.count(F.lit(1)).alias("n"), *(x for c, need in needs for x in (F.min(c).alias(f"least{c}"), F.count_if(F.col(c) >= need).alias(f"good{c}")))).first()

    def told(name: str, column: str | None, need: float, actual, good: int) -> dict:
        return {"constraint": name, "column": column, "required": float(need), "actual": None if actual is None else float(actual), "compliant_classes": good, "total_classes": row["n"], "rate": good / row["n"] if row["n"] else None, "valid": good == row["n"]}

    out = [told("k_anonymity", None, k, row["least_s"], row["good_s"])]
    out += [told("l_diversity", c, l, row[f"least_l{i}"], row[f"good_l{i}"]) for i, c in enumerate(sensitive)]
    for c in sensitive if with_t else []:
        x = risk.class_distances(df, qi, c).agg(F.max("distance").alias("m"), F.count_if(F.col("distance") > t + 1e-12).alias("bad")).first()
        out.append(told("t_closeness", c, t, x["m"], row["n"] - x["bad"]))
    return out


def execute(df: DataFrame, qi: list[str], sensitive: list[str], primary: str = "k_anonymity", k: int = 5, l: int = 2, t: float = 0.3, most: int = 5, key: str | None = None, with_t: bool = False, level: float = 0.5) -> Execution:  # noqa: E741
    """Anonymise the original anew and validate, until what the method promises holds, ``most`` times at most.

    Each time: PSU recoding, numbers binned and rare values starred at ``level``, the
    primary method (for every sensitive column), microaggregation of numeric
    sensitive columns, then the checks of all sensitive columns. After a failure
    the least class size is raised by 1, up to 15, and for what suppression can't
    mend the level by 0.1, up to 0.9. k is always promised, l and t by their methods
    and by hybrid, t also ``with_t``.
    """
    missing = [c for c in [*qi, *sensitive] if c not in df.columns]
    if missing or not qi:
        raise ValueError(f"no columns {missing}" if missing else "no quasi-identifiers")
    unit = psu_column(df, qi)
    number = [c for c in qi if is_numeric(df, c)]
    rest = [c for c in qi if c not in number]
    wanted = {"k_anonymity"} | ({"l_diversity"} if primary in ("l_diversity", "hybrid") else set()) | ({"t_closeness"} if with_t or primary in ("t_closeness", "hybrid") else set())
    group = max(3, df.count() // 100)
    required, now, checks, i = k, df, [], 0
    for i in range(1, most + 1):
        now = anonymize.psu(df, unit) if unit and unit in qi else df
        if level > 0:
            now = anonymize.numeric_binning(now, number, max(2, int(10 * (1 - level) + 2))) if number else now
            now = anonymize.suppress_rare(now, rest) if rest else now
        if primary == "hybrid":
            now = anonymize.hybrid(now, qi, sensitive, k, l, t)
        elif primary == "pram" and key and rest:
            now = anonymize.pram(now, rest, key, 0.05)
        else:
            now = anonymize.k_anonymity(now, qi, k)
        for c in sensitive if primary in ("l_diversity", "t_closeness") else []:
            now = anonymize.l_diversity(now, qi, c, l) if primary == "l_diversity" else anonymize.t_closeness(now, qi, c, t)
        for c in (c for c in sensitive if c not in qi and is_numeric(now, c)):
            now = anonymize.microaggregate(now, [c], group, key)
        now = materialise(now, "executed")
        checks = all_checks(now, qi, sensitive, required, l, t, "t_closeness" in wanted)
        failed = {c["constraint"] for c in checks if not c["valid"]} & wanted
        if not failed or i == most:
            break
        k = min(15, k + 1) if k < 15 else k
        if failed - {"k_anonymity"}:
            level = min(0.9, level + 0.1)
    ratio = risk.suppression_ratio(now, qi).first()[0]
    return Execution(now, all(c["valid"] for c in checks if c["constraint"] in wanted), i, checks, ratio, {"k": k, "l": l, "t": t, "level": level})


def remediation(checks: list[dict]) -> list[str]:
    """R23."""
    text = {"k_anonymity": "generalise further or suppress small classes", "l_diversity": "merge classes or suppress those with few sensitive values", "t_closeness": "generalise quasi-identifiers, or coarsen the sensitive column"}
    return [f"{c['constraint']}: {c['total_classes'] - c['compliant_classes']} classes fail; {text[c['constraint']]}" for c in checks if not c["valid"]]


#: What mends a violation, gentlest first.
REMEDIES = {
    "k_anonymity": ["generalise quasi-identifiers further", "suppress rare combinations", "raise k"],
    "l_diversity": ["enforce a higher l", "generalise quasi-identifiers further", "suppress rare sensitive values"],
    "t_closeness": ["enforce a lower t", "generalise quasi-identifiers further", "perturb the sensitive column"],
}
ANEW = "optimise anew with stricter parameters"


def post_validation(after: DataFrame, before: DataFrame, qi: list[str], sensitive: list[str], k: int = 5, l: int = 2, t: float = 0.2) -> DataFrame:  # noqa: E741
    """(constraint, column, required, actual, met, failing_classes, actions) of an anonymised table; t is the distance of its classes to the original's distribution.

    k once, l and t for each sensitive column. Where more than one constraint fails,
    optimising anew is one of the actions. Values of the anonymised table that the
    original lacks count with a share of 0; nulls of a sensitive column don't count.
    """
    rows = [(c["constraint"], c["column"], c["required"], c["actual"], c["valid"], c["total_classes"] - c["compliant_classes"]) for c in all_checks(after, qi, sensitive, k, l, t, with_t=False)]
    keys = [f"_k{i}" for i in range(len(qi))]
    for c in sensitive:
        cells = after.filter(F.col(c).isNotNull()).groupBy(*(F.col(q).alias(x) for q, x in zip(qi, keys, strict=True)), F.col(c).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        known = before.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_w")).agg(F.count(F.lit(1)).alias("_g"))
        total = known.agg(F.sum("_g").alias("_n"))
        share = known.join(F.broadcast(total)).select("_w", (F.col("_g") / F.col("_n")).alias("_q"))
        sized = risk._sized(materialise(cells, "validated"), keys)
        q = F.coalesce("_q", F.lit(0.0))
        d = sized.join(share, F.col("_v") == F.col("_w"), "left").groupBy(*keys).agg((0.5 * (F.sum(F.abs(F.col("_c") / F.col("_s") - q)) + 1 - F.sum(q))).alias("_d"))
        x = d.agg(F.max("_d").alias("m"), F.count_if(F.col("_d") > t + 1e-12).alias("bad")).first()
        rows.append(("t_closeness", c, float(t), x["m"], not x["bad"], x["bad"]))
    again = [ANEW] if sum(not r[4] for r in rows) > 1 else []
    schema = "constraint string, column string, required double, actual double, met boolean, failing_classes long, actions array<string>"
    return after.sparkSession.createDataFrame([(*r, [] if r[4] else REMEDIES[r[0]] + again) for r in rows], schema)


@dataclass
class KnowledgeBase:
    """Rules, methods, recommendations and their history."""

    rules: list[Rule] = field(default_factory=rule_base)
    methods: dict[str, dict] = field(default_factory=lambda: {k: dict(v) for k, v in METHODS.items()})
    history: list[RecommendationSet] = field(default_factory=list)
    feedback: list[dict] = field(default_factory=list)

    def add_rule(self, rule: Rule) -> None:
        self.rules.append(rule)

    def add_method(self, key: str, label: str, params: dict, fn: Callable[..., DataFrame] | None = None) -> None:
        self.methods[key] = {"label": label, "params": params}
        if fn:
            anonymize.register_transform(key, fn)

    def recommend(self, p: dict) -> RecommendationSet:
        r = recommend(p, self.rules)
        self.history.append(r)
        return r

    def statistics(self) -> dict:
        """R37."""
        counts = Counter(m for r in self.history for m in r.methods)
        levels = [SEVERITY[r.severity] for r in self.history if r.severity]
        return {"recommendations": len(self.history), "methods": dict(counts), "average_level": sum(levels) / len(levels) if levels else None}


@runtime_checkable
class Agent(Protocol):
    """Whatever looks at a profile and its recommendations, and adds to them."""

    def analyze(self, profile: dict, recommended: RecommendationSet) -> dict: ...


class PrivacyAgent:
    def analyze(self, profile: dict, recommended: RecommendationSet) -> dict:
        return {"overall_risk": profile.get("overall_risk"), "k_needed": max(2, 5 - int(_n(profile, "min_group_size", 0)) + 2)}


class UtilityAgent:
    def analyze(self, profile: dict, recommended: RecommendationSet) -> dict:
        return {"mean_entropy": profile.get("mean_entropy"), "gentlest": next((m for m in recommended.methods if m not in ("suppression", "attribute_suppression")), None)}


def consult(agents: list[Agent], profile: dict, recommended: RecommendationSet) -> dict[str, dict]:
    return {type(a).__name__: a.analyze(profile, recommended) for a in agents}
