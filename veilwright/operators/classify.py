"""Column roles: direct identifier, quasi-identifier, sensitive, or none of these.

Statistics of all columns come from ``profile`` in a few aggregates; the rules
work on the resulting row per column, on the driver, as their number is the
schema's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profile
from .classes import equivalence_classes

DIRECT, QUASI, SENSITIVE, NONE = "DIRECT_IDENTIFIER", "QUASI_IDENTIFIER", "SENSITIVE", "NON_SENSITIVE"

# Names that decide a role, and words of names by category.
DIRECT_NAMES = ("district", "psu", "snumber", "hhno", "person_serial_no", "person_serial_number", "household_number", "household_no")
QUASI_NAMES = ("age", "sex", "education", "marital_status", "maritalstatus", "occupation", "industry", "sector", "residence", "residence_type", "urban_rural", "urbanrural", "rural_urban")
SENSITIVE_NAMES = ("religion", "ethnicity", "ethnic")
DIRECT_WORDS = {
    "id": ("id", "identifier", "uuid", "guid", "ssn", "social security"),
    "name": ("name", "firstname", "lastname", "fullname", "surname", "given name"),
    "email": ("email", "e-mail", "mail"),
    "phone": ("phone", "telephone", "mobile", "cell", "contact"),
    "address": ("address", "street", "postal", "zip", "postcode"),
    "ip": ("ip", "ip address", "ipaddress"),
    "mac": ("mac address", "macaddress"),
    "passport": ("passport", "passport number", "passportno"),
    "license": ("license", "driving license", "license number", "licenseno"),
    "account": ("account", "account number", "accountno", "bank account"),
}
QUASI_WORDS = {
    "age": ("age", "dob", "date of birth", "birthdate", "birth date", "year of birth", "yob"),
    "gender": ("gender", "sex", "male", "female"),
    "location": ("location", "city", "town", "village", "ward", "region", "province", "state", "county"),
    "education": ("education", "edu", "qualification", "degree", "school", "university"),
    "occupation": ("occupation", "job", "profession", "employment", "work"),
    "marital": ("marital", "marriage", "married", "single", "divorced", "widowed"),
    "industry": ("industry", "sector", "economic sector"),
    "residence": ("residence", "residence_type", "urban", "rural", "urban_rural"),
    "race": ("race", "ethnicity", "ethnic"),
    "language": ("language", "lang", "mother tongue"),
    "postcode": ("postcode", "postal code", "zip code", "zip"),
    "coordinates": ("latitude", "longitude", "lat", "lon", "coord"),
}
SENSITIVE_WORDS = {
    "health": ("health", "medical", "disease", "illness", "diagnosis", "treatment", "hospital", "clinic", "disability"),
    "income": ("income", "salary", "wage", "earnings", "revenue", "pay"),
    "financial": ("financial", "bank", "credit", "debt", "loan", "mortgage", "asset", "wealth"),
    "religion": ("religion", "religious", "faith", "belief", "denomination"),
    "ethnicity": ("ethnicity", "ethnic", "race", "tribal", "caste"),
    "political": ("political", "party", "vote", "voting", "election"),
    "sexual": ("sexual", "orientation", "lgbt", "lgbtq"),
    "criminal": ("criminal", "crime", "arrest", "conviction", "felony", "misdemeanor"),
    "genetic": ("genetic", "dna", "genome", "biometric"),
}
STRATA = {"district", "sector", "region", "province"}
ORDINAL_SCALES = [["low", "medium", "high"], ["none", "primary", "secondary", "tertiary"], ["poor", "fair", "good", "excellent"], ["never", "rarely", "sometimes", "often", "always"], ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"], ["small", "medium", "large"], ["child", "teen", "adult", "senior"]]
KIND_WORDS = {
    "age": {"age"},
    "zipcode": {"zip", "zipcode", "postal", "postcode"},
    "date": {"date", "dob", "birthdate"},
    "income": {"income", "salary", "wage"},
    "occupation": {"occupation", "job", "profession"},
    "education": {"education", "degree", "qualification"},
    "gender": {"gender", "sex"},
    "geography": {"city", "district", "province", "country", "nation", "region", "location"},
}


def tokens(name: str, prefixes: bool = True) -> set[str]:
    """Words of a column name; with ``prefixes``, without a leading table prefix of one letter or two."""
    parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if p]
    if prefixes and len(parts) > 1 and len(parts[0]) <= 2 and parts[0] not in ("id", "ip"):
        parts = parts[1:]
    return set(parts)


def name_words(name: str) -> str:
    """The words of a name in order, with spaces around each."""
    return " " + " ".join(p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if p) + " "


def has(name: str, phrases) -> bool:
    """Whether one of some words or phrases stands in the name as whole words."""
    own = name_words(name)
    return any(name_words(p) in own for p in phrases)


def is_named(name: str, names) -> bool:
    """Whether the name, without the prefix of its table, is one of ``names``."""
    return any(x == name_words(n).strip() for n in names for x in (name_words(name).strip(), name_words(name).strip().split(" ", 1)[-1] if re.match(r"^[a-z]{1,2}_", name.lower()) else ""))


@dataclass
class Words:
    """The words by which columns get a role; ``more`` words of a data set are added to categories of their own or known ones."""

    direct: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DIRECT_WORDS))
    quasi: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(QUASI_WORDS))
    sensitive: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SENSITIVE_WORDS))

    def more(self, **extra: dict[str, tuple[str, ...]]) -> Words:
        """``more(quasi={"segment": ("mktsegment",)})``."""
        return Words(**{k: {c: (*getattr(self, k).get(c, ()), *extra.get(k, {}).get(c, ())) for c in {**getattr(self, k), **extra.get(k, {})}} for k in ("direct", "quasi", "sensitive")})


@dataclass
class Role:
    column: str
    role: str
    confidence: float
    reasons: list[str] = field(default_factory=list)


def _stats(df: DataFrame) -> dict[str, dict]:
    s = {r["column"]: r.asDict() for r in profile.profiling_stats(df).collect()}
    rates: dict[str, tuple[float, str]] = {}
    text = [c for c, k in df.dtypes if k == "string"]
    if text:
        for r in profile.pattern_rates(df, text).collect():
            rates[r["column"]] = max(rates.get(r["column"], (0.0, "")), (r["confidence"], r["category"]))
    for c, x in s.items():
        present = x["total_rows"] - x["missing"]
        x |= {"present": present, "u": x["n_unique"] / present if present else 0.0, "pii": rates.get(c, (0.0, "")), "numeric": profile.dtype_group(dict(df.dtypes)[c]) == "numeric"}
    return s


def direct_score(name: str, x: dict, words: Words) -> tuple[float, list[str]]:
    """A name of the list 1, a whole word .95, the rate of values that look like personal data; nearly unique values add .1, or make a code of .8."""
    if is_named(name, DIRECT_NAMES):
        return 1.0, ["name of a direct identifier"]
    score, why = 0.0, []
    if any(has(name, w) for w in words.direct.values()):
        score, why = 0.95, ["word of the name"]
    if x["pii"][0] > score:
        score = x["pii"][0]
        why.append(f"values look like {x['pii'][1]}")
    if x["u"] > 0.95 and x["present"] > 10:
        if score:
            score = min(1.0, score + 0.1)
            why.append("nearly unique")
        elif {"id", "key", "code"} & tokens(name):
            score, why = 0.8, ["nearly unique, and a code"]
    elif score and x["u"] < 0.5 and not x["pii"][0]:
        score = 0.0  # a name alone is no evidence if most values repeat
    return score, why


def word_score(name: str, words: dict[str, tuple[str, ...]]) -> tuple[float, str]:
    """Jaccard similarity of the name's words to a category's, + .3 if any stands in it; the best category."""
    own = tokens(name)
    best = (0.0, "")
    for k, phrases in words.items():
        ws = {w for p in phrases for w in name_words(p).split()}
        best = max(best, (len(own & ws) / len(own | ws) + (0.3 if has(name, phrases) else 0.0), k))
    return best


def quasi_score(name: str, x: dict, words: Words) -> float:
    """C2."""
    s, kind = word_score(name, words.quasi)
    if s <= 0.3:
        return 0.0
    return min(1.0, 1.2 * s + (0.1 if 0.1 < x["u"] < 0.9 else 0) + (0.15 if kind == "age" and x["numeric"] else 0))


def sensitive_score(name: str, x: dict, words: Words) -> float:
    """C3."""
    s, kind = word_score(name, words.sensitive)
    if s <= 0.25:
        return 0.0
    return min(1.0, 1.3 * s + (0.2 if kind == "income" and x["numeric"] else 0) + (0.15 if kind in ("religion", "ethnicity") and 1 < x["n_unique"] < 50 else 0))


def detect_roles(df: DataFrame, words: Words | None = None) -> list[Role]:
    """The role of every column, in order of name; direct identifiers first, then names of the lists, then the better score."""
    words, out = words or Words(), []
    for name, x in sorted(_stats(df).items()):
        d, why = direct_score(name, x, words)
        q, s = quasi_score(name, x, words), sensitive_score(name, x, words)
        if d >= 0.5:
            out.append(Role(name, DIRECT, round(d, 4), why))
        elif is_named(name, SENSITIVE_NAMES):
            out.append(Role(name, SENSITIVE, max(0.9, round(s, 4)), ["name of a sensitive attribute"]))
        elif is_named(name, QUASI_NAMES):
            out.append(Role(name, QUASI, max(0.9, round(q, 4)), ["name of a quasi-identifier"]))
        elif q > s and q > 0.3:
            out.append(Role(name, QUASI, round(q, 4), ["words of the name"]))
        elif s > 0.25:
            out.append(Role(name, SENSITIVE, round(s, 4), ["words of the name"]))
        else:
            out.append(Role(name, NONE, 0.5, []))
    return out


def role_table(spark: SparkSession, roles: list[Role]) -> DataFrame:
    return spark.createDataFrame([(r.column, r.role, float(r.confidence), ", ".join(r.reasons)) for r in roles], "column string, role string, confidence double, reasons string")


def selected(roles: list[Role], least: float = 0.8) -> dict[str, list[str]]:
    """Columns by role whose confidence is more than ``least``."""
    out: dict[str, list[str]] = {DIRECT: [], QUASI: [], SENSITIVE: [], NONE: []}
    for r in roles:
        if r.confidence > least or r.role == NONE:
            out[r.role].append(r.column)
    return out


def role_counts(roles: DataFrame) -> DataFrame:
    """C18."""
    return roles.groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"), F.avg("confidence").alias("avg_confidence"))


def heuristic_roles(df: DataFrame, words: Words | None = None) -> list[tuple[str, str, str]]:
    """(column, role, action) by words of the name and uniqueness."""
    words, out = words or Words(), []
    for c, x in _stats(df).items():
        if has(c, ("id", "name", "email", "phone", "nic", "passport")) or x["u"] > 0.9 and not x["numeric"]:
            out.append((c, "Direct Identifier", "drop"))
        elif word_score(c, words.sensitive)[0] > 0.25:
            out.append((c, "Sensitive", "synthesize"))
        elif word_score(c, words.quasi)[0] > 0.3:
            out.append((c, "Quasi-identifier", "synthesize"))
        else:
            out.append((c, "Non-sensitive", "resample"))
    return out


def strata_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if tokens(c) & STRATA]


def map_roles(columns: list[str], detected: list[Role] | None = None, chosen: dict[str, str] | None = None) -> dict[str, str]:
    """What the user chose, else what was detected (by exact class), else non-sensitive."""
    by = {r.column: r.role for r in detected or []}
    return {c: (chosen or {}).get(c) or by.get(c, NONE) for c in columns}


def drop_direct(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """C10."""
    return df.drop(*(c for c, r in roles.items() if r in (DIRECT, "Direct Identifier")))


def is_ordinal(df: DataFrame, c: str) -> bool:
    """P23."""
    if profile.dtype_group(dict(df.dtypes)[c]) == "numeric":
        return True
    r = df.agg(F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("double").isNotNull().cast("double"))).alias("num")).first()
    if (r["num"] or 0) > 0.8:
        return True
    values = df.select(F.lower(F.trim(F.col(c).cast("string"))).alias("v")).filter("v IS NOT NULL").distinct()
    # One row: how many values there are, and how many of each scale.
    found = values.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("v").isin(*s)).alias(f"s{i}") for i, s in enumerate(ORDINAL_SCALES))).first()
    return found["n"] > 0 and any(found[f"s{i}"] >= 0.6 * found["n"] for i in range(len(ORDINAL_SCALES)))


def attribute_kind(df: DataFrame, c: str) -> str:
    """By words of the name first, else by the range and number of values."""
    words = tokens(c)
    for kind, ws in KIND_WORDS.items():
        if words & ws:
            return kind
    x = df.agg(F.count(c).alias("n"), F.count_distinct(c).alias("u"), F.min(F.col(c).cast("string").try_cast("double")).alias("lo"), F.max(F.col(c).cast("string").try_cast("double")).alias("hi"), F.count(F.col(c).cast("string").try_cast("double")).alias("num")).first()
    if not x["n"]:
        return "categorical"
    if x["num"] == x["n"]:
        return "age" if x["u"] < 0.5 * x["n"] and x["lo"] >= 0 and x["hi"] <= 120 and x["u"] > 15 else "numeric"
    return "categorical"


def validate_identifiers(wanted: list[str], left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    """C14: valid names are in both tables; suggestions for the others; a warning if fewer than half are valid."""
    both = [c for c in left.columns if c in right.columns]
    valid = [c for c in wanted if c in both]
    out = {"valid": valid, "invalid": [c for c in wanted if c not in both], "suggestions": [], "warnings": []}
    for c in out["invalid"]:
        out["suggestions"] += [f"{c} -> {s}" for s in profile.suggest_columns(c, both)]
    if wanted and len(valid) < 0.5 * len(wanted):
        out["warnings"].append("fewer than half of the identifiers are in both tables")
    return out


def suggest_mappings(left: DataFrame, right: DataFrame, most_distinct: int = 100, overlap: float = 0.8) -> DataFrame:
    """(left_column, right_column, overlap) of categorical columns that share most values; the best three of each left column."""
    from pyspark.sql import Window

    def side(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c, k in df.dtypes if k == "string"]
        v = profile.value_counts(df, cols).select(F.col("column").alias(name), F.lower(F.trim("value")).alias("v")).distinct()
        n = v.groupBy(name).agg(F.count(F.lit(1)).alias(f"n_{name}")).filter(F.col(f"n_{name}") <= most_distinct)
        return v.join(F.broadcast(n), name)

    a, b = side(left, "left_column"), side(right, "right_column")
    # At most ``most_distinct`` values a column on either side.
    common = a.join(b, "v").groupBy("left_column", "right_column").agg(F.count(F.lit(1)).alias("common"), F.first("n_left_column").alias("x"), F.first("n_right_column").alias("y"))
    out = common.withColumn("overlap", F.col("common") / F.least("x", "y")).filter(F.col("overlap") >= overlap)
    rank = F.row_number().over(Window.partitionBy("left_column").orderBy(F.desc("overlap"), "right_column"))
    return out.withColumn("r", rank).filter("r <= 3").select("left_column", "right_column", "overlap")


def resolve_mapping(qi: list[str], left: DataFrame, right: DataFrame, explicit: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> dict[str, str]:
    """Explicit mapping first, then the same name, then the best suggestion; identifiers and sensitive columns take no part."""
    explicit = explicit or {}
    for a, b in explicit.items():
        if a not in left.columns or b not in right.columns:
            raise ValueError(f"no columns {a} and {b}")
    suggested = {r["left_column"]: r["right_column"] for r in reversed(suggest_mappings(left, right).orderBy("left_column", F.desc("overlap")).collect())}
    out = {}
    for c in qi:
        to = explicit.get(c) or (c if c in right.columns else suggested.get(c))
        if to and c not in exclude and to not in exclude:
            out[c] = to
    return out


def recommend_strategy(df: DataFrame, qi: list[str], sensitive: list[str], direct: list[str]) -> DataFrame:
    """C17: synthetic, anonymize or hybrid, by the share of singleton classes; with a default privacy budget by width."""
    n = df.count()
    share = equivalence_classes(df, qi).filter("class_size = 1").count() / n if qi and n else 0.2
    level = "high" if share >= 0.6 else "medium" if share >= 0.3 else "low"
    width = len(df.columns)
    epsilon = 0.6 if width > 40 else 0.8 if width > 20 else 1.0
    strategy = "synthetic" if level == "high" else "hybrid" if level == "medium" else "anonymize"
    return df.sparkSession.createDataFrame([(strategy, level, round(share, 6), epsilon, len(direct), len(qi), len(sensitive))], "strategy string, risk_level string, uniqueness_risk double, epsilon double, n_direct int, n_quasi int, n_sensitive int")


GRANULARITY = ((50, "coarse"), (1000, "medium"))


def semantic_roles(df: DataFrame, words: Words | None = None) -> DataFrame:
    """(column, qi_score, role, granularity): .4 for times, .35 for numbers with 2 to 85 % and for text with 1 to 60 % distinct values, .35 for a word of the name, .1 for at most 10 % nulls; a QI from .55 on, unless a word makes it sensitive."""
    kinds = dict(df.dtypes)
    words = words or Words()
    flags = [(c, profile.dtype_group(kinds[c]), word_score(c, words.quasi)[0] > 0.3, word_score(c, words.sensitive)[0] > 0.3) for c in df.columns]
    named = df.sparkSession.createDataFrame(flags, "column string, kind string, quasi_word boolean, sensitive_word boolean")
    x = profile.profiling_stats(df).join(F.broadcast(named), "column")
    u = F.coalesce(F.try_divide(F.col("n_unique"), F.col("total_rows") - F.col("missing")), F.lit(0.0))
    base = F.when(F.col("kind") == "datetime", 0.4).when((F.col("kind") == "numeric") & u.between(0.02, 0.85), 0.35).when((F.col("kind") == "categorical") & u.between(0.01, 0.6), 0.35).otherwise(0.0)
    score = base + F.when(F.col("quasi_word"), 0.35).otherwise(0.0) + F.when(F.col("missing_pct") <= 10, 0.1).otherwise(0.0)
    role = F.when(F.col("sensitive_word"), SENSITIVE).when(score >= 0.55, QUASI).otherwise(NONE)
    grain = F.when(F.col("n_unique") <= GRANULARITY[0][0], GRANULARITY[0][1]).when(F.col("n_unique") <= GRANULARITY[1][0], GRANULARITY[1][1]).otherwise("fine")
    return x.select("column", score.alias("qi_score"), role.alias("role"), grain.alias("granularity"))


def date_like(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of values that read as a time, and whether that is over 70 % or the name says so."""
    row = df.agg(*(F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.try_to_timestamp(F.trim(F.col(c).cast("string"))).isNotNull().cast("double"))), F.lit(0.0)).alias(c) for c in cols))
    named = [c for c in cols if tokens(c) & {"date", "dob", "time", "timestamp", "birthdate"}]
    return row.unpivot([], cols, "column", "share").withColumn("date_like", (F.col("share") > 0.7) | F.col("column").isin(named))
