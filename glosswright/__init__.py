"""Rule-guided text editing, its evaluation and telemetry on PySpark; the interface is in api."""

_API = ("Candidate", "CandidateProvider", "EventSink", "Plan", "RulePlan", "RulesParser", "Scorer", "Selector", "compile_rules", "run_step")

__all__ = list(_API)


def __getattr__(name: str):
    # workers import this package for small parts of it
    if name not in _API:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from glosswright import api

    return getattr(api, name)
