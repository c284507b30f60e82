"""Generalisation hierarchies: per attribute a table (level, value, label), or arithmetic where labels are regular.

Level 0 is the value itself, and a level is never coarser than the next. Labels
of a level lie in one label of the next, but for bands of 20 years, which those
of 50 years cut. Labels are attached by a join on the distinct values
of a column, so a hierarchy costs by its values, not by rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import materialise, written
from ..functions.ranks import prefix_sums
from .anonymize import NUMERIC, STAR, suppress_small
from .classes import equivalence_classes

# The levels of the registered templates. Places and jobs are given as label -> members of the level below.
OCCUPATION = [
    {
        "Healthcare": ["doctor", "nurse", "pharmacist", "dentist"],
        "Education": ["teacher", "lecturer", "professor", "tutor"],
        "Engineering": ["engineer", "technician", "architect"],
        "IT": ["developer", "programmer", "analyst"],
        "Business": ["manager", "accountant", "banker", "clerk"],
        "Trade": ["driver", "carpenter", "mason", "electrician", "plumber"],
        "Agriculture": ["farmer", "fisherman"],
        "Service": ["cook", "waiter", "cleaner", "guard"],
    },
    {"Professional": ["Healthcare", "Education", "Engineering", "IT"], "Commercial": ["Business"], "Manual": ["Trade", "Agriculture", "Service"]},
    {"Worker": ["Professional", "Commercial", "Manual"]},
]
EDUCATION = [
    {"No schooling": ["none", "no schooling"], "Primary": ["primary", "grade 1-5"], "Secondary": ["secondary", "o/l", "a/l", "high school"], "Diploma": ["diploma", "certificate"], "Bachelor": ["bachelor", "degree", "bsc", "ba"], "Postgraduate": ["master", "phd", "doctorate", "msc", "mba"]},
    {"Below tertiary": ["No schooling", "Primary", "Secondary"], "Tertiary": ["Diploma", "Bachelor"], "Postgraduate level": ["Postgraduate"]},
    {"Educated": ["Below tertiary", "Tertiary", "Postgraduate level"]},
]
GENDER = [{"Male": ["m", "male", "man", "1"], "Female": ["f", "female", "woman", "2"], "Other": ["o", "other", "non-binary", "x"]}, {"Person": ["Male", "Female", "Other"]}]
GEOGRAPHY = [
    {
        "Colombo": [f"Colombo {n}" for n in range(1, 16)],
        "Kandy": ["Kandy", "Kandy North", "Kandy South"],
        "Galle": ["Galle", "Galle North", "Galle South"],
        "Jaffna": ["Jaffna", "Jaffna North", "Jaffna South"],
        "Kurunegala": ["Kurunegala", "Kurunegala North", "Kurunegala South"],
        "Anuradhapura": ["Anuradhapura", "Anuradhapura East", "Anuradhapura West"],
        "Ratnapura": ["Ratnapura", "Ratnapura North", "Ratnapura South"],
        "Matale": ["Matale", "Matale North", "Matale South"],
        "Nuwara Eliya": ["Nuwara Eliya", "Nuwara Eliya West", "Nuwara Eliya East"],
        "Gampaha": ["Gampaha", "Gampaha North", "Gampaha South", "Negombo", "Katana"],
    },
    {
        "Western Province": ["Colombo", "Gampaha", "Kalutara"],
        "Central Province": ["Kandy", "Matale", "Nuwara Eliya"],
        "Southern Province": ["Galle", "Matara", "Hambantota"],
        "Northern Province": ["Jaffna", "Kilinochchi", "Mannar", "Mullaitivu", "Vanni"],
        "Eastern Province": ["Batticaloa", "Trincomalee", "Ampara"],
        "North Central Province": ["Anuradhapura", "Polonnaruwa"],
        "Sabaragamuwa Province": ["Ratnapura", "Kegalle"],
        "Uva Province": ["Badulla", "Moneragala"],
        "North Western Province": ["Kurunegala", "Puttalam"],
    },
]
GEOGRAPHY += [{"Sri Lanka": list(GEOGRAPHY[1])}, {"Asia": ["Sri Lanka"]}]


def _band(x: Column, width: int) -> Column:
    lo = (F.floor(x / width) * width).cast("long")
    return F.concat(lo.cast("string"), F.lit("-"), (lo + width - 1).cast("string"))


def age_label(x: Column, level: int) -> Column:
    """5, 10, 20 and 50 year bands, then '*'; ages outside 0..99 stay as they are."""
    v = x.cast("double")
    text = x.cast("string")
    if level == 0:
        return text
    if level >= 5:
        return F.when(x.isNotNull(), STAR)
    width = (5, 10, 20, 50)[level - 1]
    return F.when(v.between(0, 99.999), _band(v, width)).otherwise(text)


def income_label(x: Column, level: int) -> Column:
    """Bands of 10, 25 and 50 thousand, then below or from 100 thousand; from 200 thousand on as they are."""
    v = x.cast("double")
    text = x.cast("string")
    if level == 0:
        return text
    if level >= 5:
        return F.when(x.isNotNull(), STAR)
    inside = (v >= 0) & (v < 200_000)
    label = F.when(v < 100_000, "<100000").otherwise(">=100000") if level == 4 else _band(v, (10_000, 25_000, 50_000)[level - 1])
    return F.when(inside, label).otherwise(text)


def zipcode_label(x: Column, level: int) -> Column:
    """The last ``level`` + 1 of five characters are masked; others stay."""
    text = x.cast("string")
    if level == 0:
        return text
    if level >= 4:
        return F.when(F.length(text) == 5, F.substring(text, 1, 1) if level == 4 else F.lit(STAR)).otherwise(text)
    keep = (3, 2, 1)[level - 1]
    return F.when(F.length(text) == 5, F.concat(F.substring(text, 1, keep), F.lit("*" * (5 - keep)))).otherwise(text)


def date_label(x: Column, level: int) -> Column:
    """Band of days in the month, month, year, decade, century."""
    d = x.try_cast("date")
    text = x.cast("string")
    day = F.dayofmonth(d)
    band = F.when(day <= 7, "1-7").when(day <= 14, "8-14").when(day <= 21, "15-21").otherwise("22-31")
    decade, century = (F.floor(F.year(d) / 10) * 10).cast("string"), (F.floor(F.year(d) / 100) * 100).cast("string")
    labels = [text, F.concat(F.date_format(d, "yyyy-MM"), F.lit(" "), band), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy"), F.concat(decade, F.lit("s")), F.concat(century, F.lit("s"))]
    return F.when(d.isNull(), text).otherwise(labels[level] if level < len(labels) else F.lit(STAR))


EXPRESSIONS = {"age": (age_label, 5), "income": (income_label, 5), "zipcode": (zipcode_label, 5), "date": (date_label, 6)}
TABLES = {"geography": GEOGRAPHY, "occupation": OCCUPATION, "education": EDUCATION, "gender": GENDER}


@dataclass
class Hierarchy:
    """levels[i] maps a label of level i + 1 to its members on level i; an expression takes the place of the maps for regular labels, a written table (value) that of the one level at which its values are '*'."""

    attribute: str
    levels: list[dict[str, list[str]]] = field(default_factory=list)
    kind: str | None = None
    numeric: tuple[float, float, int] | None = None
    current: int = 0
    starred: str | None = None

    @property
    def max_level(self) -> int:
        if self.starred:
            return 2
        if self.kind:
            return EXPRESSIONS[self.kind][1]
        return self.numeric[2] + 1 if self.numeric else len(self.levels) + 1

    def add_level(self, members: dict[str, list[str]]) -> Hierarchy:
        self.levels.append(members)
        return self

    def can_generalize_more(self) -> bool:
        return self.current < self.max_level

    def set_level(self, level: int) -> int:
        """Never back, never beyond the top."""
        self.current = max(self.current, min(level, self.max_level))
        return self.current

    def leaves(self, level: int) -> dict[str, str]:
        """value -> label at ``level``; a value may be a label of a lower level already; values without a label aren't listed."""
        now: dict[str, str] = {}
        for i, members in enumerate(self.levels[:level]):
            up = {m.lower() if i == 0 else m: label for label, ms in members.items() for m in ms}
            now = dict(up) if i == 0 else {v: up.get(x, x) for v, x in now.items()} | {m.lower(): x for m, x in up.items() if m.lower() not in now}
        return now

    def generalize(self, value: str, level: int) -> str:
        if level >= self.max_level and not self.kind and not self.numeric:
            return STAR
        return self.leaves(level).get(str(value).lower(), value) if level else value

    def values_at(self, level: int) -> list[str]:
        return sorted(set(self.leaves(level).values())) if level else sorted({m for ms in self.levels[0].values() for m in ms} if self.levels else [])

    def table(self, spark: SparkSession) -> DataFrame:
        """(attribute, level, value, label)."""
        rows = [(self.attribute, n, v, x) for n in range(1, len(self.levels) + 1) for v, x in sorted(self.leaves(n).items())]
        return spark.createDataFrame(rows, "attribute string, level int, value string, label string")

    def column(self, df: DataFrame, c: str, level: int | None = None) -> DataFrame:
        """``df`` with ``c`` at ``level`` (the current one by default); unknown values stay, nulls too."""
        level = self.current if level is None else min(level, self.max_level)
        x = F.col(c)
        if self.kind:
            return df.withColumn(c, EXPRESSIONS[self.kind][0](x, level))
        if self.numeric:
            lo, hi, n = self.numeric
            if level == 0 or level > n:
                return df.withColumn(c, x.cast("string") if level == 0 else F.when(x.isNotNull(), STAR))
            # 2**(n + 1 - level) equal ranges: coarser by one half with each level.
            width = (hi - lo) / 2 ** (n + 1 - level)
            i = F.least(F.lit(2 ** (n + 1 - level) - 1), F.greatest(F.lit(0), F.floor((x.cast("double") - lo) / (width or 1.0)).cast("int")))
            return df.withColumn(c, F.when(x.isNotNull(), F.concat((lo + i * width).cast("string"), F.lit("-"), (lo + (i + 1) * width).cast("string"))))
        if level == 0:
            return df.withColumn(c, x.cast("string"))
        if level >= self.max_level:
            return df.withColumn(c, F.when(x.isNotNull(), STAR))
        if self.starred:
            values = df.sparkSession.read.schema("value string").parquet(self.starred)
            out = df.join(values, F.lower(x.cast("string")) == F.col("value"), "left")
            return out.withColumn(c, F.when(F.col("value").isNotNull(), STAR).otherwise(x.cast("string"))).drop("value")
        labels = self.table(df.sparkSession).filter(F.col("level") == level).select("value", "label")
        # The table is part of the program text, so of bounded size.
        out = df.join(F.broadcast(labels), F.lower(x.cast("string")) == F.col("value"), "left")
        return out.withColumn(c, F.coalesce("label", x.cast("string"))).drop("value", "label")

    def to_dict(self) -> dict:
        return {"attribute": self.attribute, "levels": self.levels, "kind": self.kind, "numeric": list(self.numeric) if self.numeric else None, "current": self.current, "starred": self.starred}

    @classmethod
    def from_dict(cls, d: dict) -> Hierarchy:
        return cls(d["attribute"], d["levels"], d["kind"], tuple(d["numeric"]) if d["numeric"] else None, d["current"], d.get("starred"))


def template(attribute: str, kind: str) -> Hierarchy:
    """The registered template of a kind of attribute."""
    if kind in EXPRESSIONS:
        return Hierarchy(attribute, kind=kind)
    return Hierarchy(attribute, levels=[dict(x) for x in TABLES[kind]])


def numeric_hierarchy(attribute: str, lo: float, hi: float, levels: int = 4) -> Hierarchy:
    return Hierarchy(attribute, numeric=(float(lo), float(hi), levels))


def categorical_hierarchy(attribute: str, groups: dict[str, list[str]]) -> Hierarchy:
    return Hierarchy(attribute, levels=[groups])


@dataclass
class HierarchyManager:
    """The hierarchies of a table's QIs."""

    by_name: dict[str, Hierarchy] = field(default_factory=dict)

    def add(self, h: Hierarchy) -> None:
        self.by_name[h.attribute] = h

    def set_level(self, attribute: str, level: int) -> int:
        return self.by_name[attribute].set_level(level)

    def info(self, spark: SparkSession, qi: list[str]) -> DataFrame:
        """A28."""
        rows = [(c, c in self.by_name, h.max_level if h else 0, h.current if h else 0, (h.values_at(h.current)[:10] if h and h.levels else [])) for c in qi for h in [self.by_name.get(c)]]
        return spark.createDataFrame(rows, "attribute string, has_hierarchy boolean, max_level int, current_level int, sample_values array<string>")

    def to_dict(self) -> dict:
        return {k: h.to_dict() for k, h in self.by_name.items()}

    @classmethod
    def from_dict(cls, d: dict) -> HierarchyManager:
        return cls({k: Hierarchy.from_dict(x) for k, x in d.items()})

    def generalize(self, df: DataFrame, levels: dict[str, int]) -> DataFrame:
        """Each QI at its level; one without a hierarchy is binned into max(2, 5 - level) ranges, or loses values with less than .1 level of the rows to '*'."""
        from .anonymize import generalize_rare, numeric_binning

        for c, level in levels.items():
            if c in self.by_name:
                df = self.by_name[c].column(df, c, level)
            elif level <= 0:
                df = df.withColumn(c, F.col(c).cast("string"))
            elif dict(df.dtypes)[c] in NUMERIC:
                df = numeric_binning(df, [c], max(2, 5 - level), "Range_")
            else:
                df = generalize_rare(df, [c], 0.1 * level, STAR)
        return df

    def k_anonymity(self, df: DataFrame, qi: list[str], k: int) -> tuple[DataFrame, dict]:
        """Levels 1, 2, ... for all QIs until every class has k rows; after the top, small classes of the last level are suppressed.

        Each level is tried on the distinct QI values with their counts.
        """
        base = materialise(df.groupBy(*qi).agg(F.count(F.lit(1)).alias("_n")), "qi-values")
        top = max([h.max_level for c, h in self.by_name.items() if c in qi], default=3)
        level = 0
        for level in range(1, max(1, top) + 1):
            sizes = self.generalize(base, dict.fromkeys(qi, level)).groupBy(*qi).agg(F.sum("_n").alias("s")).agg(F.min("s"), F.count(F.lit(1))).first()
            if sizes[0] is None or sizes[0] >= k:
                break
        out = self.generalize(df, dict.fromkeys(qi, level))
        if sizes[0] is not None and sizes[0] < k:
            out = suppress_small(out, qi, k)
            sizes = equivalence_classes(out, qi).agg(F.min("class_size"), F.count(F.lit(1))).first()
        return out, {"iterations": level, "generalization_used": dict.fromkeys(qi, level), "min_group_size": sizes[0], "num_groups": sizes[1]}

    def auto(self, df: DataFrame, qi: list[str], least: int = 5) -> HierarchyManager:
        """A hierarchy by the kind of each QI; of others, values with at least ``least`` rows keep themselves and the rest is '*'."""
        from .classify import attribute_kind

        for c in qi:
            if c in self.by_name:
                continue
            kind = attribute_kind(df, c)
            if kind in EXPRESSIONS or kind in TABLES:
                self.add(template(c, kind))
            elif dict(df.dtypes)[c] in NUMERIC:
                lo, hi = df.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
                self.add(numeric_hierarchy(c, lo or 0.0, hi or 0.0))
            else:
                # However many values are rare: they are a table, not a list on the driver.
                rare = df.groupBy(F.lower(F.col(c).cast("string")).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(f"n < {least} AND value IS NOT NULL")
                self.add(Hierarchy(c, starred=written(rare.select("value"), "rare-values")))
        return self


def partition_candidates(h: Hierarchy) -> list[tuple[str, str]]:
    """Labels of the next level that cover more than one label of the current one."""
    if not h.levels or h.current >= len(h.levels):
        return []
    return [(h.attribute, label) for label, ms in h.levels[h.current].items() if len(ms) > 1]


def value_partitions(df: DataFrame, manager: HierarchyManager, qi: list[str], k: int, name: str = "partition") -> DataFrame:
    """``df`` with the partition of each row, by splits of one value against the rest; every partition has at least k rows if the table has.

    A partition is split by the first QI that has a label (at the hierarchy's current
    level) with k rows on either side, the most frequent label first, smallest of
    equals. QIs without a hierarchy, or at its top, are not split by. Of one QI all
    splits follow from the labels' counts in a partition: each label of k rows
    becomes a partition of its own, the others stay together, and if these have
    fewer than k rows, the rarest such label (the last split) stays with them. No
    later split makes an earlier QI splittable again, so there is one round a QI
    for all partitions, of aggregates and joins on distinct labels.
    """
    from .classes import null_safe

    usable = [c for c in qi if c in manager.by_name and manager.by_name[c].can_generalize_more()]
    # Distinct values first, so a label is looked up once a value.
    keys, labels = [f"_q{i}" for i in range(len(usable))], [f"_l{i}" for i in range(len(usable))]
    if not usable:
        return df.withColumn(name, F.lit("0"))
    base = df.groupBy(*(F.col(c).alias(q) for c, q in zip(usable, keys, strict=True))).agg(F.count(F.lit(1)).alias("_n"))
    for c, q, x in zip(usable, keys, labels, strict=True):
        base = manager.by_name[c].column(base.withColumn(x, F.col(q)), x)
    base = materialise(base.withColumn("_p", F.lit("0")), "value-partitions")
    for i, x in enumerate(labels):
        counts = base.groupBy("_p", F.coalesce(F.col(x), F.lit("")).alias("_v"), F.col(x).isNull().alias("_null")).agg(F.sum("_n").alias("_c"))
        own = F.col("_c") >= k
        # The rarest label of k rows: the largest of equals.
        ends = counts.groupBy(F.col("_p").alias("_pp")).agg(F.coalesce(F.sum(F.when(~own, F.col("_c"))), F.lit(0)).alias("_rest"), F.max(F.when(own, F.struct((-F.col("_c")).alias("c"), F.col("_null").alias("n"), F.col("_v").alias("v")))).alias("_last"))
        split = counts.join(ends, F.col("_p") == F.col("_pp")).withColumn("_kept", (F.col("_rest") > 0) & (F.col("_rest") < k) & (F.col("_v") == F.col("_last.v")) & (F.col("_null") == F.col("_last.n")))
        # A partition of few labels, none of them split off, keeps its name.
        part = F.when(own & ~F.col("_kept"), F.concat("_p", F.lit(f"/{i}:"), F.when(F.col("_null"), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_v"))))).otherwise(F.col("_p"))
        split = split.select(F.col("_p").alias("_op"), F.col("_v").alias("_ov"), F.col("_null").alias("_on"), part.alias("_np"))
        on = (F.col("_p") == F.col("_op")) & (F.coalesce(F.col(x), F.lit("")) == F.col("_ov")) & (F.col(x).isNull() == F.col("_on"))
        base = materialise(base.join(split, on).withColumn("_p", F.col("_np")).drop("_op", "_ov", "_on", "_np"), "value-partitions")
    named = base.select(*keys, F.col("_p").alias("_part"))
    return df.drop(name).join(named, null_safe(df, named, list(zip(usable, keys, strict=True)))).withColumn(name, F.col("_part")).drop(*keys, "_part")


def mondrian(df: DataFrame, qi: list[str], k: int, name: str = "partition") -> DataFrame:
    """A24 by medians, for QIs without a hierarchy: ``df`` with the partition of each row; every partition has at least k rows if the table has.

    In each round every partition is cut at the median of the QI that has most
    distinct values in it among those whose cut leaves k rows on either side
    (numbers by size, others by name); all partitions are cut in the same round.
    The rounds work on distinct QI values with counts.
    """
    def place(q: str) -> list[Column]:
        """Nulls first, then by number, then by name."""
        v = F.col(q)
        return [v.isNotNull().cast("int").alias("_a"), F.coalesce(v.cast("string").try_cast("double"), F.lit(float("-inf"))).alias("_b"), F.coalesce(v.cast("string"), F.lit("")).alias("_s")]

    keys = [f"_q{i}" for i in range(len(qi))]
    base = df.groupBy(*(F.col(c).alias(q) for c, q in zip(qi, keys, strict=True))).agg(F.count(F.lit(1)).alias("_n"))
    base = materialise(base.withColumn("_p", F.lit("0")).withColumn("_open", F.lit(True)), "mondrian-0")
    rounds = 0
    while True:
        rounds += 1
        best = None
        for i, q in enumerate(keys):
            # Rows up to each value of the QI within each open partition, over ranges of both, to find the cut.
            values = base.filter("_open").groupBy("_p", *place(q)).agg(F.sum("_n").alias("_c")).withColumn("_one", F.lit(1).cast("long"))
            run = materialise(prefix_sums(values, [F.col(x) for x in ("_p", "_a", "_b", "_s")], {"_to": "_c", "_at": "_one"}), f"mondrian-values-{rounds}")
            ends = run.groupBy("_p").agg(F.min(F.col("_to") - F.col("_c")).alias("_o"), F.max("_to").alias("_e"), F.min("_at").alias("_f"), F.count(F.lit(1)).alias("_m"))
            run = run.join(ends, "_p").select("_p", "_m", (F.col("_to") - F.col("_o")).alias("_upto"), (F.col("_e") - F.col("_o")).alias("_all"), (F.col("_at") - F.col("_f")).alias("_r"), "_a", "_b", "_s")
            good = run.filter((F.col("_upto") >= k) & (F.col("_all") - F.col("_upto") >= k))
            nearest = F.min(F.struct(F.abs(2 * F.col("_upto") - F.col("_all")).alias("d"), (F.col("_r")).alias("r"), "_a", "_b", "_s")).alias("_x")
            cut = good.groupBy("_p").agg(F.max("_m").alias("_m"), nearest).select("_p", "_m", F.lit(i).alias("_i"), "_x")
            best = cut if best is None else best.unionByName(cut)
        chosen = best.groupBy("_p").agg(F.max(F.struct(F.col("_m"), (-F.col("_i")).alias("j"), "_x")).alias("_y"))
        chosen = materialise(chosen.select(F.col("_p").alias("_cp"), (-F.col("_y.j")).alias("_i"), F.struct("_y._x._a", "_y._x._b", "_y._x._s").alias("_cut")), f"mondrian-cuts-{rounds}")
        if chosen.isEmpty():
            break
        joined = base.join(chosen, F.col("_p") == F.col("_cp"), "left")
        low = F.lit(None).cast("boolean")
        for i, q in enumerate(keys):
            low = F.when(F.col("_i") == i, F.struct(*place(q)) <= F.col("_cut")).otherwise(low)
        side = F.when(F.col("_i").isNull(), F.lit("")).when(low, "0").otherwise("1")
        base = joined.select(*keys, "_n", F.concat("_p", side).alias("_p"), F.col("_i").isNotNull().alias("_open"))
        base = materialise(base, f"mondrian-{rounds}")
    from .classes import null_safe

    named = base.select(*keys, F.col("_p").alias(name))
    return df.join(named, null_safe(df, named, list(zip(qi, keys, strict=True)))).drop(*keys)


__all__ = ["Hierarchy", "HierarchyManager", "categorical_hierarchy", "mondrian", "numeric_hierarchy", "partition_candidates", "template", "value_partitions"]
