"""Rule-guided text editing, its evaluation and telemetry on PySpark.

The engine's main steps, and the seams at which a user's own parts fit in:

* Scorer: proposals (DataFrame) to proposals with a score, see operators.scoring.
* CandidateProvider: a rule plan to its candidates, replacing those of the ruleset.
* Selector: scored proposals (Column of an array) to the accepted ones.
* EventSink: takes the event log, see sources.sinks.
* RulesParser: a ruleset's text to a compiled plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from glosswright.operators import editing
from glosswright.operators.scoring import Scorer
from glosswright.plans.ir import Candidate, Plan, RulePlan, compile_rules

CandidateProvider = Callable[[RulePlan], tuple[Candidate, ...]]
Selector = Callable[[Column], Column]
EventSink = Callable[[DataFrame], None]
RulesParser = Callable[[str], Plan]

__all__ = ["Candidate", "CandidateProvider", "EventSink", "Plan", "RulePlan", "RulesParser", "Scorer", "Selector", "compile_rules", "run_step"]


def run_step(
    documents: DataFrame,
    rules: str,
    parser: RulesParser = compile_rules,
    candidates: CandidateProvider | None = None,
    selector: Selector = editing.settle,
    sink: EventSink | None = None,
) -> DataFrame:
    """One step of a ruleset over documents (doc_id, text), see operators.editing.step."""
    plan = parser(rules)
    if candidates:
        plan = Plan(tuple(replace(r, candidates=candidates(r)) for r in plan.rules))
    out = editing.step(documents, plan, selector)
    if sink:
        sink(editing.events(out))
    return out
