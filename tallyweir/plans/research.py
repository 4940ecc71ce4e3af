"""The research flow over any number of panels: gates first, then every step for all panels and splits at once."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocate, backtest, evidence, gates, risk, splits
from ..schemas import ResearchPolicy
from ..sources.scratch import materialize

RULES = list(allocate.REGISTRY)


class Research:
    """The frames of a run. What several steps read is written once.

    close=True: a panel that fails its gate ends the run. close=False: failing panels are set aside, the others go on, and the trace has a row for each one set aside.
    Rules beyond the budget end either.
    """

    def __init__(self, panel: DataFrame, bench: DataFrame, current: DataFrame, as_of: str, rules: list[str], p: ResearchPolicy = ResearchPolicy(), expected: list[str] | None = None, close: bool = True):
        gates.require_budget(rules, p)
        self.p, self.rules, self.bench, self.current = p, rules, bench, current
        self.all = materialize(panel, "panel")
        self.gate = gates.panel_gate(self.all, as_of, p.min_train + p.test, expected)
        if close:
            gates.require(self.gate)
            self.panel = self.all
        else:
            self.gate = materialize(self.gate, "gate")
            self.panel = gates.quarantined(self.all, self.gate)

    @cached_property
    def cov(self) -> DataFrame:
        return materialize(risk.train_covariance(self.panel, self.p), "cov")

    def train(self) -> DataFrame:
        return splits.walk_forward_rows(self.panel, "train", self.p)

    def test(self) -> DataFrame:
        return splits.walk_forward_rows(self.panel, "test", self.p)

    def _built(self, cov: DataFrame, rows: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [allocate.build(r, cov, rows) for r in self.rules])

    @cached_property
    def _allocations(self) -> DataFrame:
        return materialize(self._built(self.cov, self.train()), "allocations")

    def allocations(self) -> DataFrame:
        return self._allocations

    @cached_property
    def _held(self) -> DataFrame:
        return materialize(backtest.constrained(self.allocations(), self.bench, self.current, self.cov, self.p), "held")

    def held(self) -> DataFrame:
        return self._held

    def execution(self) -> DataFrame:
        return backtest.execution(self.panel, self.p)

    @cached_property
    def _returns(self) -> DataFrame:
        return materialize(backtest.portfolio_returns(self.held(), self.test()), "returns")

    @cached_property
    def _evaluated(self) -> DataFrame:
        diff = backtest.differential(self._returns, backtest.portfolio_returns_folded(self.held(), self.test()), self.p.tolerance)
        facts = backtest.evaluation(self.held(), self.test(), self.p, self._returns)
        return materialize(facts.join(diff.select(*backtest.RULE, F.col("status").alias("differential_status"), F.col("worst").alias("differential_max_abs")), backtest.RULE), "evaluated")

    def evaluated(self) -> DataFrame:
        return self._evaluated

    def report(self) -> DataFrame:
        return backtest.report(self.evaluated(), self.execution(), self.test(), self.allocations())

    def matrix(self) -> DataFrame:
        return backtest.with_stability(backtest.challenge_matrix(self.evaluated(), self.rules, self.all), backtest.stability(self.held(), self.p))

    def trace(self) -> DataFrame:
        return backtest.filter_trace(self.allocations(), self.all, self.gate)

    def rejected(self) -> DataFrame:
        return backtest.rejected(self.trace(), self.rules, self.all)

    def cpcv(self) -> DataFrame:
        """RULE, status and the evaluation on the combinatorial splits; a rule that was not OK keeps its row, with nulls."""
        rows = materialize(splits.purged(self.panel, self.p, len(self.rules)), "purged")
        cov = materialize(risk.purged_covariance(self.panel, self.p), "cov").join(rows.select(*splits.SPLIT).distinct(), splits.SPLIT, "left_semi")
        built = materialize(self._built(cov, rows.filter("role = 'train'")), "allocations")
        held = materialize(backtest.constrained(built, self.bench, self.current, cov, self.p), "held")
        facts = backtest.evaluation(held, rows.filter("role = 'test'"), self.p)
        return built.select(*backtest.RULE, "status").distinct().join(facts, backtest.RULE, "left")

    def require_sound(self) -> None:
        """Ends the run where a split, a cap, a return path or an attribution does not hold."""
        missing = self.panel.select("panel_id").distinct().join(splits.walk_forward(self.panel, self.p).select("panel_id").distinct(), "panel_id", "left_anti")
        gates.require_status(missing, F.lit(False), "NO_WALK_FORWARD_SPLITS")
        gates.require_status(self.execution(), F.col("aligned"), "WALK_FORWARD_EXECUTION_ALIGNMENT_FAILED")
        bad = backtest.conserved(self.held(), self.bench, self.cov, self.p).agg(F.min(F.when(F.col("status") != "OK", F.col("status")))).first()[0]
        if bad:
            raise gates.ResearchClosed(bad)
        gates.require_status(self.evaluated(), F.col("differential_status") == "PASS", "DIFFERENTIAL_BACKTEST_DIVERGENCE")
        gates.require_status(backtest.attribution(self.held(), self.test(), self.p), F.col("identity_status") == "PASS", "ATTRIBUTION_IDENTITY_FAILED")

    def write(self, folder: str) -> DataFrame:
        """Writes the evidence of a run below folder, the fingerprint and the pre-registration before any result, and gives the manifest, which is written last.

        Tables are Parquet, but those named .json, documents of a line each. An existing folder, a broken invariant or an empty output ends the run.
        """
        spark = self.all.sparkSession
        before = evidence.written({"data_fingerprint.json": evidence.panel_fingerprint(self.all), "pre_registration.json": evidence.pre_registration(spark, self.rules, self.p), "panel_gate.json": self.gate}, folder, "json")
        self.require_sound()
        tables = {"walk_forward_results": self.report(), "challenge_matrix": self.matrix(), "stability_regions": backtest.stability(self.held(), self.p), "constraint_diagnostics": backtest.constraint_diagnostics(self.held()), "cpcv_results": self.cpcv(),
                  "rejected_candidates": self.rejected(), "performance_attribution": backtest.attribution(self.held(), self.test(), self.p)}
        documents = {"candidate_filter_trace.json": self.trace(), "shadow_replay.json": backtest.replay(self.evaluated(), self.execution(), self.panel, self.test()),
                     "decision_snapshot.json": backtest.snapshot(self.panel, backtest.latest_targets(self.held()), self.bench, self.current, self.execution(), self.p), "differential_backtest.json": self.evaluated().select(*backtest.RULE, "differential_status", "differential_max_abs")}
        done = reduce(DataFrame.unionByName, [before, evidence.written(tables, folder), evidence.written(documents, folder, "json")])
        evidence.require_outputs(done)
        evidence.written({"run_manifest.json": done}, folder, "json")
        return done
