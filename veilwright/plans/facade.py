"""One object per table, with a verb for each thing that can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..operators import anonymize, attack, classify, fusion, hierarchy, linkage, pareto, profile, risk, synthetic, utility
from . import expert


@dataclass(frozen=True)
class PrivacyContext:
    """A table with its key and the roles of its columns; immutable, each choice gives a new one."""

    df: DataFrame
    key: str
    qi: list[str] = field(default_factory=list)
    sensitive: list[str] = field(default_factory=list)
    direct: list[str] = field(default_factory=list)
    nulls: str = "keep"

    def with_roles(self, qi: list[str] | None = None, sensitive: list[str] | None = None, direct: list[str] | None = None) -> PrivacyContext:
        """U4: unknown columns are refused."""
        wanted = [*(qi or []), *(sensitive or []), *(direct or [])]
        if unknown := [c for c in wanted if c not in self.df.columns]:
            raise ValueError(f"no columns {unknown}")
        return replace(self, qi=self.qi if qi is None else qi, sensitive=self.sensitive if sensitive is None else sensitive, direct=self.direct if direct is None else direct)

    # Quasi-identifiers

    def auto_detect(self, least: float = 0.8) -> tuple[PrivacyContext, DataFrame]:
        roles = classify.detect_roles(self.df)
        chosen = classify.selected(roles, least)
        ctx = self.with_roles([c for c in chosen[classify.QUASI] if c != self.key], [c for c in chosen[classify.SENSITIVE] if c != self.key], [c for c in chosen[classify.DIRECT] if c != self.key])
        return ctx, classify.role_table(self.df.sparkSession, roles)

    def validate_risk(self) -> DataFrame:
        return risk.validated(self.df, self.qi, self.nulls)

    def search_combinations(self, most: int = 3) -> DataFrame:
        return risk.combination_search(self.df, self.qi, most, self.nulls)

    def l_diversity(self) -> DataFrame:
        return risk.l_summary(self.df, self.qi, self.sensitive[0], self.nulls)

    def evidence(self, n: int = 10) -> tuple[DataFrame, DataFrame]:
        return risk.size_histogram(self.df, self.qi, self.nulls), risk.riskiest_classes(self.df, self.qi, n, self.nulls)

    # Anonymisation

    def analyze(self, **settings) -> tuple[dict, expert.RecommendationSet]:
        p = expert.full_profile(self.df, self.qi, self.sensitive[0] if self.sensitive else None, **settings)
        return p, expert.recommend(p)

    def anonymize(self, method: str = "k_anonymity", k: int = 5, l: int = 2, t: float = 0.3) -> expert.Execution:  # noqa: E741
        scaled = anonymize.scaled_parameters(self.df.count(), k, l, t)
        return expert.execute(self.df, self.qi, self.sensitive, method, int(scaled["k"]), int(scaled["l"]), scaled["t"], key=self.key)

    def comprehensive(self, done: expert.Execution) -> tuple[DataFrame, DataFrame]:
        return anonymize.comprehensive(self.df, done.data, self.key, self.direct, self.qi, self.sensitive)

    def compare(self, after: DataFrame) -> tuple[DataFrame, DataFrame]:
        return risk.compare(self.df, after, self.key, self.qi), risk.modified_rows(self.df, after, self.key, self.qi)

    def with_hierarchies(self, k: int = 5) -> tuple[DataFrame, dict]:
        return hierarchy.HierarchyManager().auto(self.df, self.qi).k_anonymity(self.df, self.qi, k)

    def pipelines(self, n: int = 5) -> list[expert.Pipeline]:
        known, advice = self.analyze()
        return expert.generate_pipelines(self.qi, list(advice.methods), n, advice.triggered, known["n"])

    def optimize(self, population: int = 15, generations: int = 8, seed: int = 42) -> tuple[dict, list]:
        return pareto.search(pareto.measured_objectives(self.df, self.qi), population, generations, seed)

    # Synthetic data

    def synthesize(self, n: int | None = None, epsilon: float = 1.0, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
        others = [c for c in self.df.columns if c not in {*self.qi, *self.sensitive, *self.direct, *(strata or []), self.key}]
        return synthetic.generate(self.df, [*self.qi, *self.sensitive], others, n, epsilon, seed, strata, self.key)

    def synthetic_report(self, made: DataFrame, epsilon: float = 1.0) -> dict:
        return utility.report(self.df, made, [*self.qi, *self.sensitive], epsilon)

    # Attack

    def inspect(self) -> dict[str, DataFrame]:
        text = [c for c, k in self.df.dtypes if k == "string"]
        out = {"overview": profile.overview(self.df), "types": profile.infer_types(self.df), "stats": profile.profiling_stats(self.df), "anomalies": profile.anomalies(self.df, (self.key,))}
        if num := profile.numeric_columns(self.df):
            out["numeric"] = profile.numeric_summary(self.df, num)
        if text:
            out["categorical"] = profile.categorical_summary(self.df, text)
        return out

    def attack(self, aux: DataFrame, aux_key: str, blocking: list[str], mapping: dict[str, str] | None = None, folds: int = 5) -> AttackReport:
        """Pairs, models, scores, internal risk, contributions and fusion against this (anonymised) table."""
        resolved = classify.resolve_mapping(self.qi, aux, self.df, mapping, tuple(self.direct + self.sensitive))
        pairs = materialise(linkage.pair_dataset(aux, self.df, aux_key, self.key, list(resolved), [b for b in blocking if b in resolved], resolved), "pairs")
        model = attack.run_attack(pairs, folds)
        records = materialise(fusion.record_risk(model.score(pairs.filter(F.col("label") == 1))), "records")
        internal = materialise(fusion.internal_risk(self.df, self.key, self.qi, self.sensitive[0] if self.sensitive else None, attack.local_outlier_factor(self.df, self.qi)), "internal")
        final = materialise(fusion.final_risk(records, internal), "final")
        importance, local = attack.contributions(model, pairs)
        columns = materialise(fusion.column_risk(importance, pairs, final, model.features), "columns")
        return AttackReport(pairs, model, records, internal, final, importance, local, columns)


@dataclass(frozen=True)
class AttackReport:
    pairs: DataFrame
    model: attack.Attack
    records: DataFrame
    internal: DataFrame
    final: DataFrame
    importance: DataFrame
    local: DataFrame
    columns: DataFrame

    def vulnerable(self, top: int = 10, least: float = 0.0) -> DataFrame:
        return fusion.vulnerable_columns(self.columns, top, least)

    def summary(self) -> DataFrame:
        return fusion.level_summary(self.final, "final_risk_score", "final_risk_level")


def pipeline_status(report: AttackReport | None) -> dict[str, bool]:
    """Which results there are, and have rows."""
    parts = ("pairs", "records", "internal", "final", "importance", "local", "columns")
    return {p: report is not None and not getattr(report, p).isEmpty() for p in parts}
