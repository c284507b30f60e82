"""Text reports made from aggregates by fixed templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fusion import SUFFIXES

ADVICE = {"numeric": "band or microaggregate it", "categorical": "merge rare values or apply PRAM"}


def primary_columns(local: DataFrame) -> DataFrame:
    """Per pair the column whose feature has the largest |contribution|."""
    base = local.withColumn("column", F.regexp_replace("feature", SUFFIXES, ""))
    per = base.groupBy("aux_index", "anon_index", "column").agg(F.max_by("contribution", F.abs("contribution")).alias("contribution"))
    order = Window.partitionBy("aux_index", "anon_index").orderBy(F.desc(F.abs("contribution")), "column")
    return per.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def dataset_report(summary: dict[str, dict], columns: list[dict], high: float = 70, low: float = 30) -> str:
    """M9: the state of a release, from level counts and column risks."""
    total = summary.get("all", {}).get("n", 0)
    lines = ["# Re-identification risk", "", f"{total} records were scored."]
    for level in ("critical", "very_high", "high", "moderate", "medium", "low"):
        if level in summary:
            lines.append(f"- {level}: {summary[level]['n']} records ({summary[level].get('percent', 0)} %)")
    lines += ["", "## Columns", ""]
    for c in columns:
        score = c["vulnerable_score"]
        state = "drives the attack" if score >= high else "adds to it" if score > low else "adds little"
        lines.append(f"- {c['base']}: score {score:.1f}, {state}; {ADVICE['numeric' if c.get('numeric') else 'categorical']}")
    return "\n".join(lines)


def record_report(record: dict, top: list[dict]) -> str:
    """M9: why one record is at risk."""
    why = ", ".join(f"{t['feature']} ({t['contribution']:+.3f})" for t in top[:5])
    return f"Record {record['anon_index']}: final risk {record['final_risk_score']:.1f} ({record['final_risk_level']}). Main reasons: {why or 'none known'}."
