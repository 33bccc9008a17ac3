"""Aggregation of the engine's event log and of rule telemetry across cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions.text import safe_divide
from glosswright.operators.evaluation import coverage_budget


def rule_metrics(events: DataFrame, *keys: str) -> DataFrame:
    """Evaluations, firings, proposals by kind and applied patches of each rule."""
    is_ = lambda t: F.col("type") == t
    made = is_("ProposalsGenerated")
    total = lambda c: F.coalesce(F.sum(F.when(made, F.col(c))), F.lit(0)).cast("long")
    return events.groupBy(*keys, "rule_id").agg(
        F.count_if(is_("RuleEvaluationStarted")).alias("evaluations"),
        F.count_if(made & (F.col("proposals_count") > 0)).alias("firings"),
        total("proposals_count").alias("proposals"),
        total("generated_count").alias("generated"),
        total("fallback_count").alias("fallback"),
        total("static_count").alias("static"),
        F.count_if(is_("ProposalAccepted")).alias("applied"),
    )


def condition_metrics(events: DataFrame, *keys: str) -> DataFrame:
    """How often each guard condition was seen and matched; a marker names its section."""
    section = F.when(F.col("marker").isNotNull(), F.split_part("marker", F.lit("_"), F.lit(1))).otherwise(F.col("node_path"))
    operator = F.when(F.col("marker").isNotNull(), F.coalesce(F.nullif(F.split_part("marker", F.lit("_"), F.lit(2)), F.lit("")), F.lit("any"))).otherwise(F.col("node_type"))
    seen = events.filter(F.col("type") == "GuardConditionEvaluated").withColumns({"section": section, "operator": operator})
    out = seen.groupBy(*keys, "rule_id", "section", "operator", "debug_expression").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("matched").alias("matched")
    )
    return out.withColumn("match_rate", safe_divide(F.col("matched"), F.col("seen")))


def candidate_choices(events: DataFrame, *keys: str) -> DataFrame:
    """How often each candidate was accepted, with its latest label; an empty id is an error."""
    chosen = events.filter(F.col("type") == "ProposalAccepted")
    cid = F.when(F.coalesce("candidate_id", F.lit("")) != "", F.col("candidate_id")).otherwise(F.raise_error(F.lit("an accepted candidate has no id")))
    return chosen.groupBy(*keys, "rule_id", "candidate_kind", cid.alias("candidate_id")).agg(
        F.max_by("candidate_label", "seq").alias("label"), F.count(F.lit(1)).alias("chosen")
    )


def episodes(events: DataFrame, *keys: str) -> DataFrame:
    """Probe episodes: what was requested and generated, how much was popped, whether all."""
    by = [*keys, "rule_id", "cache_key"]
    is_ = lambda t: F.col("type") == t
    return events.filter(F.col("cache_key").isNotNull()).groupBy(*by).agg(
        F.max(F.when(is_("AvoidProbeEpisodeStarted"), F.col("probe_budget"))).alias("requested"),
        F.coalesce(F.max(F.when(is_("AvoidProbeSetGenerated"), F.col("generated_count"))), F.lit(0)).alias("generated"),
        F.count_if(is_("AvoidProbeCandidatePopped")).alias("popped"),
        F.coalesce(F.bool_or(is_("AvoidProbeCacheExhausted")), F.lit(False)).alias("exhausted"),
    )


def across_cases(per_case: DataFrame) -> DataFrame:
    """Sums over cases by rule, and in how many cases it fired.

    per_case: case_id, rule_id, evaluations, firings, applied, decision_limit_reached.
    """
    return per_case.groupBy("rule_id").agg(
        F.countDistinct("case_id").alias("cases"),
        F.countDistinct(F.when(F.col("firings") > 0, F.col("case_id"))).alias("fired_cases"),
        F.sum("evaluations").alias("evaluations"),
        F.sum("firings").alias("firings"),
        F.sum("applied").alias("applied"),
        F.bool_or("decision_limit_reached").alias("limit_reached"),
    )


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def merged_by_name(stats: DataFrame) -> DataFrame:
    """Rules of one normalised name together; fired cases never exceed all cases.

    Rules of one name that differ in cases are an error, whatever columns are read.
    """
    merged = stats.groupBy(normal_name(F.col("rule_name")).alias("name")).agg(
        F.min("cases").alias("fewest"), F.max("cases").alias("cases"), F.least(F.sum("fired_cases"), F.max("cases")).alias("fired_cases"),
        F.sum("evaluations").alias("evaluations"), F.sum("applied").alias("applied"),
    )
    same = F.when(F.col("fewest") == F.col("cases"), F.lit(True)).otherwise(F.raise_error(F.lit("rules of one name differ in cases")).cast("boolean"))
    return merged.filter(same).drop("fewest")


def rule_stats(rules: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """rules (rule_id, rule_name) with fired_cases and applied: of their name, else of their id, else 0."""
    named = by_name.select(F.col("name").alias("_name"), F.struct("fired_cases", "applied").alias("_named"))
    own = by_id.select("rule_id", F.struct("fired_cases", "applied").alias("_own"))
    out = rules.withColumn("_name", normal_name(F.col("rule_name"))).join(named, "_name", "left").join(own, "rule_id", "left")
    found = F.coalesce("_named", "_own")
    at = lambda c: F.coalesce(found[c], F.lit(0)).alias(c)
    return out.select("rule_id", "rule_name", at("fired_cases"), at("applied"), F.when(F.col("_named").isNotNull(), "name").when(F.col("_own").isNotNull(), "id").alias("found_by"))


def leading_rules(stats: DataFrame, choices: DataFrame, k: int = 3) -> DataFrame:
    """list, place, rule_name: the k most active rules, those with most edits a firing, and the most active with fallbacks.

    stats: rule_id, rule_name, fired, applied. choices: rule_id, candidate_kind, chosen.
    """
    fell = choices.filter("candidate_kind = 'fallback' and chosen > 0").select("rule_id").distinct()
    active, name = F.desc("fired"), F.asc("rule_name")
    lists = {
        "active": (stats, [active, F.desc("applied"), name]),
        "repeat": (stats.filter("fired > 0 and applied > 0"), [F.desc(F.col("applied") / F.col("fired")), name]),
        "fallback": (stats.join(fell, "rule_id", "left_semi"), [active, name]),
    }
    out = None
    for title, (rows, order) in lists.items():
        first = rows.orderBy(*order).limit(k)  # k rows
        placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(title).alias("list"), "place", "rule_name")
        out = placed if out is None else out.unionByName(placed)
    return out


def snapshot(stats: DataFrame, conditions: DataFrame, choices: DataFrame) -> DataFrame:
    """Rules in order of their ids, each with its sorted conditions and candidates."""
    seen = conditions.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("section", "operator", "debug_expression", "seen", "matched"))).alias("conditions"))
    chosen = choices.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("candidate_kind", "candidate_id", "label", "chosen"))).alias("candidates"))
    return stats.join(seen, "rule_id", "left").join(chosen, "rule_id", "left").orderBy("rule_id")


#: Depth that an accepted fallback counts as.
FALLBACK_DEPTH = 11
FAMILIES = ("replace", "after", "avoid", "force")


def probe_depth(kind: Column, candidate_id: Column) -> Column:
    """The number of a generated probe, FALLBACK_DEPTH for a fallback, else null."""
    number = F.regexp_extract(candidate_id, r"^probe_(\d{1,9})$", 1)
    return F.when(kind == "fallback", F.lit(FALLBACK_DEPTH)).when((kind == "generated") & (number != ""), F.nullif(number, F.lit("")).cast("int"))


def summary(cases: DataFrame, rules: DataFrame, choices: DataFrame, events: DataFrame) -> DataFrame:
    """One row that sums a run up: sums, means, maxima and shares by rule family.

    cases: case_id, applied_decisions, runtime_sec. rules: case_id, rule_id, rule_name,
    evaluations, applied, firings. choices: case_id, rule_id, rule_name, candidate_kind,
    candidate_id, chosen. events: case_id, rule_id, rule_name, type, reason, cache_key,
    generated_count, probe_budget. Each table is reduced to one row before they meet.
    """
    div, n0 = safe_divide, lambda c: F.coalesce(c, F.lit(0)).cast("long")
    one = lambda df, *aggs: df.agg(*aggs).withColumn("one", F.lit(1))
    run = one(cases, F.count(F.lit(1)).alias("n_cases"), n0(F.sum("applied_decisions")).alias("edits_accepted"), F.coalesce(F.sum("runtime_sec"), F.lit(0.0)).alias("runtime_seconds_total"))

    of = family(F.col("rule_name"))
    per_family = []
    for f in FAMILIES:
        mine = of == f
        per_family += [
            n0(F.sum(F.when(mine, F.col("applied")))).alias(f"{f}_applied"), n0(F.sum(F.when(mine, F.col("firings")))).alias(f"{f}_firings"),
            F.countDistinct(F.when(mine & (F.col("firings") > 0), F.col("case_id"))).alias(f"{f}_cases"),
        ]
    acted = one(rules, n0(F.sum("evaluations")).alias("edits_proposed"), *per_family)

    depth, chosen = probe_depth(F.col("candidate_kind"), F.col("candidate_id")), F.col("chosen")
    picked = choices.filter("chosen > 0").withColumn("depth", depth)
    avoided = (of == "avoid") & F.col("depth").isNotNull()
    probed = avoided & (F.col("candidate_kind") == "generated")
    total = lambda cond, name: n0(F.sum(F.when(cond, chosen))).alias(name)
    d = F.col("depth")
    picks = one(
        picked, total(F.col("candidate_kind") == "fallback", "fallbacks_used"), total(avoided, "avoid_outcomes_total"),
        F.sum(d * chosen).alias("_depths"), F.sum(F.when(d.isNotNull(), chosen)).alias("_depth_n"), n0(F.max("depth")).alias("probe_depth_max"),
        total(probed & (d == 1), "_rank_1"), total(probed & (d > 1), "_gt_1"), total(probed & (d > 3), "_gt_3"), total(probed & (d > 5), "_gt_5"),
        total(probed & (d <= 3), "_top_3"), total(probed & (d <= 5), "_top_5"),
    )

    is_ = lambda t: F.col("type") == t
    made = is_("ProposalsGenerated") & (of == "avoid")
    keyed = F.coalesce(F.col("cache_key"), F.lit("")) != ""
    log = one(
        events, n0(F.sum(F.when(made, F.col("generated_count")))).alias("probe_count_total"),
        F.count_if(made & (F.col("generated_count") > 0)).alias("avoid_firings_with_generated_candidates"),
        F.count_if(is_("AvoidProbeSetGenerated")).alias("probe_sets_generated_total"),
        n0(F.sum(F.when(is_("AvoidProbeSetGenerated"), F.col("probe_budget")))).alias("requested_probes_total"),
        n0(F.sum(F.when(is_("AvoidProbeSetGenerated"), F.col("generated_count")))).alias("_valid"),
        n0(F.sum(F.when(is_("AvoidProbeEpisodeStarted") & keyed, F.col("generated_count")))).alias("generated_probes_total"),
        F.count_if(is_("AvoidProbeCandidatePopped") & keyed).alias("consumed_generated_probes_total"),
        F.count_if(is_("AvoidProbeCacheExhausted")).alias("not_enough_probes_count"),
        F.count_if(is_("ProposalRejected") & (F.col("reason") == "conflict")).alias("conflict_resolutions"),
        F.count_if(is_("PatchSkipped")).alias("no_op_steps"),
    )

    runs = events.filter(keyed).groupBy("case_id", "cache_key").agg(
        F.bool_or(is_("AvoidProbeEpisodeStarted")).alias("began"), F.count_if(is_("AvoidProbeCandidatePopped")).alias("popped"), F.bool_or(is_("AvoidProbeCacheExhausted")).alias("exhausted")
    )
    runs = runs.filter("began")
    budgets = one(runs, F.count(F.lit(1)).alias("_episodes")).join(coverage_budget(runs).withColumn("one", F.lit(1)), "one")

    out = run
    for part in (acted, picks, log, budgets):
        out = out.join(F.broadcast(part), "one")  # one row each
    c = F.col
    fired = c("avoid_firings")
    firings = c("replace_firings") + c("after_firings") + c("avoid_firings") + c("force_firings")
    generated = c("avoid_firings_with_generated_candidates")
    episodes_ = F.when(c("_episodes") > 0, c("_episodes")).otherwise(generated)
    more = {
        "runtime_seconds_per_case": div(c("runtime_seconds_total"), c("n_cases")), "trigger_firings_total": firings, "avg_triggers_per_case": div(firings, c("n_cases")),
        "avg_interventions_per_case": div(c("edits_accepted"), c("n_cases")), "probe_count_mean": div(c("probe_count_total"), c("n_cases")), "probe_depth_mean": div(n0(c("_depths")), n0(c("_depth_n"))),
        "avoid_interventions_per_case": div(c("avoid_applied"), c("n_cases")), "avoid_probe_episodes_per_case": div(generated, c("n_cases")),
        "accepted_rank_1_share": div(c("_rank_1"), fired), "accepted_rank_gt_1_share": div(c("_gt_1"), fired), "resolved_within_top_3_share": div(c("_top_3"), fired), "resolved_within_top_5_share": div(c("_top_5"), fired),
        **{f"avoid_required_gt_{i}_share": div(c(f"_gt_{i}"), c("avoid_outcomes_total")) for i in (1, 3, 5)},
        "probe_sets_generated_per_case": div(c("probe_sets_generated_total"), c("n_cases")), "avg_valid_probes_per_generated_set": div(c("_valid"), c("probe_sets_generated_total")),
        "avg_requested_probes_per_generated_set": div(c("requested_probes_total"), c("probe_sets_generated_total")), "generated_probes_consumed_share": div(c("consumed_generated_probes_total"), c("generated_probes_total")),
        "probe_budget_for_50_coverage": n0(c("budget_50")), "probe_budget_for_80_coverage": n0(c("budget_80")), "not_enough_probes_share": div(c("not_enough_probes_count"), episodes_),
        "avg_probes_per_avoid_firing": div(c("probe_count_total"), generated),
    }
    out = out.withColumns(more)
    return out.select(*(x for x in out.columns if x != "one" and x[0] != "_" and not x.startswith("budget_")))


def condition_candidate_rows(rules: DataFrame) -> DataFrame:
    """Each rule's conditions crossed with its candidates, either side possibly empty."""
    wide = rules.select("rule_id", F.explode_outer("conditions").alias("condition"), "candidate_choices")
    return wide.select("rule_id", "condition", F.explode_outer("candidate_choices").alias("choice"))


def family(rule_name):
    """The rule family: what stands before the first colon."""
    return F.split_part(rule_name, F.lit(":"), F.lit(1))


def family_cases(per_case: DataFrame) -> DataFrame:
    """In how many cases each family fired, and its share of all firings."""
    by = per_case.groupBy(family(F.col("rule_name")).alias("family")).agg(
        F.countDistinct(F.when(F.col("firings") > 0, F.col("case_id"))).alias("fired_cases"), F.sum("firings").alias("firings")
    )
    every = F.sum("firings").over(Window.partitionBy())  # one row for each family
    return by.withColumn("share", safe_divide(F.col("firings"), every))
