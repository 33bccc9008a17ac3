"""One rule step over a table of documents: propose, score, settle, apply.

Rules are unrolled into columns, so a step is a projection: it needs no shuffle, and
documents never meet rules in a join. documents: doc_id, text, and optionally
prompt_text and tick. Without a language model a candidate's score is minus the length
of the text it would make.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.functions import guards
from glosswright.functions.text import SPACE, clause_start, first_span, folded, let, scope_start, slice_text, spaced, tail, version
from glosswright.plans.ir import Candidate, Plan, RulePlan

PROPOSAL = (
    "struct<score:double,rule_id:string,start:int,stop:int,op:string,candidate_index:int,payload:string,"
    "candidate_id:string,kind:string,label:string,rule_name:string>"
)
NOTE = "struct<rule_id:string,reason:string>"
OBSERVED = "struct<rule_id:string,path:string,type:string,marker:string,expression:string,matched:boolean>"
EVALUATED = "struct<rule_id:string,reason:string,proposals_count:int,generated_count:int,fallback_count:int,static_count:int,noop_count:int>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _anchor(rule: RulePlan, view: Column) -> Column:
    """Each phrase's first occurrence; of these the one that ends last, then starts first."""
    found = F.array(*(first_span(view, p, o) for p, o in rule.anchors))
    keyed = F.transform(F.filter(found, lambda s: s.isNotNull()), lambda s: F.struct(s["stop"].alias("stop"), (-s["start"]).alias("minus")))
    span = lambda best: F.when(best.isNotNull(), F.struct((-best["minus"]).alias("start"), best["stop"].alias("stop")))
    return let(F.array_max(keyed), span)


def _close(text: Column, depth: Column) -> Column:
    """Offset of the bracket that closes `depth` open ones, or -1."""

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "(", 1).when((c == ")") & (acc["depth"] > 0), -1).otherwise(0)
        hit = (acc["hit"] < 0) & (c == ")") & (depth == 0)
        return F.struct((acc["at"] + 1).alias("at"), depth.alias("depth"), F.when(hit, acc["at"]).otherwise(acc["hit"]).alias("hit"))

    start = F.struct(F.lit(0).alias("at"), depth.cast("int").alias("depth"), F.lit(-1).alias("hit"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)["hit"]


def _after_brackets(text: Column, span: Column, anchor: Column) -> Column:
    """Where an After rule inserts next to brackets: struct(start, stop), or null to wait.

    With a bracket open in the anchor, or opened in what follows, the rule waits for
    its end and inserts behind it and the punctuation that sticks to it.
    """
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    target = slice_text(text, anchor["start"], anchor["stop"])
    rest = slice_text(text, span["start"], span["stop"])
    open_ = F.greatest(F.lit(0), count(target, "(") - count(target, ")"))
    point = lambda at: F.struct(at.cast("int").alias("start"), at.cast("int").alias("stop"))
    behind = lambda at: point(at + F.length(F.regexp_extract(tail(text, at), r"^[,.!?*]+", 0)))
    first_open = F.instr(rest, "(")
    closed = F.when(open_ > 0, _close(rest, open_)).otherwise(first_open + _close(tail(rest, first_open), F.lit(1)))
    found = F.when(open_ > 0, _close(rest, open_) >= 0).otherwise(_close(tail(rest, first_open), F.lit(1)) >= 0)
    lead = F.length(F.regexp_extract(rest, f"^[{SPACE}]*", 0))
    left = F.regexp_extract(F.substring(text, F.lit(1), span["start"]), rf"\)([{SPACE}]*[.,!?*])?[{SPACE}]*$", 0)
    inner = F.length(F.regexp_extract(left, rf"^\)([{SPACE}]*[.,!?*])?", 0))
    near = span["start"] - F.length(left) + inner
    # blanks only: insert right behind a bracket that was closed before them
    beside = F.when((F.length(rest) > 0) & (lead == F.length(rest)) & (left != ""), point(near)).otherwise(span)
    return (
        F.when((open_ == 0) & (count(rest, "(") > count(rest, ")")), F.lit(None))
        .when((open_ == 0) & (F.substring(rest, lead + 1, F.lit(1)) == ")"), behind(span["start"] + lead + 1))
        .when((open_ == 0) & (first_open == 0), beside)
        .when(found, behind(span["start"] + closed + 1))
    )


def _after_text(text: Column, span: Column, candidate: str) -> Column:
    """An After candidate in the case that the punctuation around it asks for."""
    inside = F.regexp_extract(slice_text(text, span["start"], span["stop"]), f"^[{SPACE}]*([,.])", 1)
    left = F.regexp_extract(F.substring(text, F.lit(1), span["start"]), f"([,.])[{SPACE}]*$", 1)
    at = next((i for i, c in enumerate(candidate) if c.isascii() and c.isalpha()), None)
    cased = lambda f: candidate if at is None else candidate[:at] + f(candidate[at]) + candidate[at + 1 :]
    lower, upper = cased(str.lower), cased(str.upper)
    return (
        F.when(inside == ",", ", " + lower)
        .when(inside == ".", ". " + upper)
        .when(left == ",", " " + lower)
        .when(left == ".", " " + upper)
        .otherwise(". " + upper)
        if candidate
        else F.lit("")
    )


def _edits(rule: RulePlan, text: Column, span: Column) -> Column:
    """The rule's proposals for one span."""

    def edit(k: int, c: Candidate) -> Column:
        raw = _after_text(text, span, c.text) if rule.kind == "after" else F.lit(c.text)

        def made(payload: Column) -> Column:
            changed = folded(slice_text(text, span["start"], span["stop"])) != folded(payload)
            score = -(F.length(text) - (span["stop"] - span["start"]) + F.length(payload)).cast("double")
            struct = F.struct(
                score.alias("score"), F.lit(rule.rule_id).alias("rule_id"), span["start"].alias("start"), span["stop"].alias("stop"),
                F.lit("replace").alias("op"), F.lit(k).alias("candidate_index"), payload.alias("payload"),
                F.lit(c.candidate_id).alias("candidate_id"), F.lit(c.kind).alias("kind"), F.lit(c.label).alias("label"),
                F.lit(rule.name).alias("rule_name"),
            )
            return F.when(changed, struct)

        return let(let(raw, lambda r: spaced(text, span["start"], span["stop"], r)), made)

    ordered = sorted(rule.candidates, key=lambda c: (-c.priority, c.label, c.text))
    return F.filter(F.array(*(edit(k, c) for k, c in enumerate(ordered))), lambda p: p.isNotNull())


def _outcome(rule: RulePlan, text: Column, prompt: Column, tick: Column) -> Column:
    """struct(edits, reason) of one rule. Each intermediate value is bound once by let."""
    kind = f"struct<edits:array<{PROPOSAL}>,reason:string>"
    no = lambda reason: F.struct(_none(PROPOSAL).alias("edits"), F.lit(reason).cast("string").alias("reason")).cast(kind)

    def made(span: Column, low: Column, edit_low: Column, view: Column) -> Column:
        if not rule.candidates:
            return no("no candidates")
        touching = F.lit(True)
        if rule.kind == "avoid" and rule.guard is not None:
            touching = guards.touches(rule.guard, view, span["start"] - low, span["stop"] - low)
        texts = [c.text for c in rule.candidates if c.text]
        shown = folded(tail(text, edit_low))
        satisfied = let(shown, lambda t: F.exists(F.array(*(folded(F.lit(c)) for c in texts)), lambda c: F.contains(t, c))) if texts else F.lit(False)
        done = let(_edits(rule, text, span), lambda e: F.struct(e.alias("edits"), F.when(F.size(e) == 0, "already fired").alias("reason")).cast(kind))
        return F.when(~touching, no("insufficient overlap actionability")).when(satisfied, no("already_satisfied")).otherwise(done)

    def bracketed(span: Column, anchor: Column) -> Column:
        if rule.kind == "after" and rule.wait_for_closing and rule.candidates:
            return F.when(F.rlike(text, F.lit(r"[()]")), _after_brackets(text, span, anchor)).otherwise(span)
        return span

    def placed(low: Column, edit_low: Column, view: Column) -> Column:
        end = F.length(text)
        point = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))
        if rule.target == "scope_entire":
            return let(point(edit_low, end), lambda s: made(s, low, edit_low, view))

        def at(local: Column) -> Column:
            a = point(local["start"] + low, local["stop"] + low)
            return F.when(local.isNull(), no("no target span")).otherwise(let(a, anchored))

        def anchored(a: Column) -> Column:
            clause = clause_start(text, a["start"], edit_low)
            start = {"match_span": a["start"], "after_anchor": a["stop"], "anchor_clause": clause}[rule.target]
            span = point(F.greatest(start, edit_low), a["stop"] if rule.target == "match_span" else end)
            seen = (a["stop"] > edit_low) & (a["start"] < end)
            found = let(let(span, lambda s: bracketed(s, a)), lambda s: F.when(s.isNull(), no("waiting_for_closing_parenthesis")).otherwise(made(s, low, edit_low, view)))
            return F.when(seen, found).otherwise(no("no target span"))

        return let(_anchor(rule, view), at)

    def guarded(low: Column) -> Column:
        def seen(view: Column) -> Column:
            inner = placed(low, low, view) if rule.edit_scope == rule.scope else let(scope_start(text, rule.edit_scope), lambda e: placed(low, e, view))
            return F.when(guards.matches(rule.guard, view, prompt), inner).otherwise(no("guard failed"))

        return let(tail(text, low), seen)

    return F.when(tick < rule.skip_tokens, no("skipped")).otherwise(let(scope_start(text, rule.scope), guarded))


def _with_rule(df: DataFrame, rule: RulePlan, i: int) -> DataFrame:
    """Adds r<i>, the rule's edits and why it makes none."""
    return df.withColumn(f"r{i}", _outcome(rule, F.col("text"), F.col("prompt_text"), F.col("tick")))


def _observed(rule: RulePlan, text: Column, prompt: Column, tick: Column) -> Column:
    """What each condition of the rule's guard gave; none of a skipped rule."""
    if rule.guard is None:
        return _none(OBSERVED)

    def seen(view: Column) -> Column:
        found = F.array(*guards.observations(rule.guard, view, prompt))
        return F.transform(found, lambda o: F.struct(F.lit(rule.rule_id).alias("rule_id"), o["path"].alias("path"), o["type"].alias("type"), o["marker"].alias("marker"), o["expression"].alias("expression"), o["matched"].alias("matched")))

    found = let(scope_start(text, rule.scope), lambda low: let(tail(text, low), seen))
    return F.when(tick < rule.skip_tokens, _none(OBSERVED)).otherwise(found.cast(f"array<{OBSERVED}>"))


def _evaluated(rule: RulePlan, outcome: Column) -> Column:
    """How many proposals by kind the rule made, and why none."""
    n = lambda kind: F.size(F.filter(outcome["edits"], lambda e: e["kind"] == kind))
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), outcome["reason"].alias("reason"), F.size(outcome["edits"]).alias("proposals_count"), n("generated").alias("generated_count"),
        n("fallback").alias("fallback_count"), n("static").alias("static_count"), outcome["reason"].isNotNull().cast("int").alias("noop_count"),
    ).cast(EVALUATED)


def propose(documents: DataFrame, plan: Plan) -> DataFrame:
    """documents plus version_id, proposals of the step, notes on rules without any, and the log's observed and evaluated.

    Only the edits at the lowest start go on to the step; the others wait for the next.
    """
    df = documents
    for name, default in (("prompt_text", F.lit("")), ("tick", F.lit(1 << 30))):
        df = df.withColumn(name, F.coalesce(name, default) if name in df.columns else default)
    df = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("version_id", version(F.col("text")))
    for i, rule in enumerate(plan.rules):
        df = _with_rule(df, rule, i)
    n = range(len(plan.rules))
    every = F.concat(*(F.col(f"r{i}.edits") for i in n)) if plan.rules else _none(PROPOSAL)
    why = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"r{i}.reason").alias("reason")) for i, r in enumerate(plan.rules)))
    notes = F.filter(why, lambda x: x["reason"].isNotNull()) if plan.rules else _none(NOTE)
    seen = [_observed(r, F.col("text"), F.col("prompt_text"), F.col("tick")) for r in plan.rules]
    df = df.withColumn("_all", every).withColumn("notes", notes).withColumn("observed", F.concat(*seen) if seen else _none(OBSERVED))
    ran = F.array(*(_evaluated(r, F.col(f"r{i}")) for i, r in enumerate(plan.rules)))
    df = df.withColumn("evaluated", F.filter(ran, lambda e: ~e["reason"].eqNullSafe(F.lit("skipped"))) if plan.rules else _none(EVALUATED))
    lowest = F.array_min(F.transform("_all", lambda p: p["start"]))
    df = df.withColumn("_low", lowest).withColumn("proposals", F.filter("_all", lambda p: p["start"] == F.col("_low")))
    return df.drop("_all", "_low", *(f"r{i}" for i in n))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans overlap; a point touches what holds it, ends included."""
    point_a, point_b = a["start"] == a["stop"], b["start"] == b["stop"]
    touch = (a["start"] <= b["stop"]) & (b["start"] <= a["stop"])
    return F.when(point_a | point_b, touch).otherwise((a["start"] < b["stop"]) & (b["start"] < a["stop"]))


def settle(proposals: Column) -> Column:
    """Greedy conflict resolution: by score, then rule, span, op, candidate; keeps what fits.

    proposals is an array of structs with score, rule_id, start, stop, op, candidate_index.
    """
    keys = lambda p: F.struct((-p["score"]).alias("k"), p["rule_id"].alias("r"), p["start"].alias("s"), p["stop"].alias("e"), p["op"].alias("o"), p["candidate_index"].alias("c"), p.alias("p"))
    ordered = F.transform(F.array_sort(F.transform(proposals, keys)), lambda x: x["p"])
    return F.aggregate(
        ordered,
        F.filter(proposals, lambda p: F.lit(False)),
        lambda kept, p: F.when(F.exists(kept, lambda k: overlaps(k, p)), kept).otherwise(F.concat(kept, F.array(p))),
    )


def splice(text: Column, accepted: Column) -> Column:
    """The text after the accepted edits, applied from the right."""
    order = F.transform(accepted, lambda p: F.struct((-p["start"]).alias("k"), p["rule_id"].alias("r"), (-p["score"]).alias("s"), p.alias("p")))
    return F.aggregate(
        F.array_sort(order),
        text,
        lambda t, x: F.concat(F.substring(t, F.lit(1), x["p"]["start"]), x["p"]["payload"], tail(t, x["p"]["stop"])),
    )


def step(documents: DataFrame, plan: Plan, selector: Callable[[Column], Column] | None = None) -> DataFrame:
    """One step of the rule engine: documents with accepted edits, new text and version."""
    df = propose(documents, plan).withColumn("accepted", (selector or settle)(F.col("proposals")))
    df = df.withColumn("new_text", splice(F.col("text"), F.col("accepted")))
    return df.withColumn("new_version_id", version(F.col("new_text"))).withColumn("history", F.transform("accepted", lambda p: p["rule_id"]))


def events(stepped: DataFrame) -> DataFrame:
    """The step's event log: doc_id, seq, type, rule_id, and what each type tells.

    Evaluations come with their guards' conditions and with how many proposals by kind
    the rule made; then what became of the proposals. event_id is derived from document,
    rule and sequence, so a replay repeats it.
    """
    fields = {
        "rule_id": "string", "reason": "string", "candidate_id": "string", "candidate_label": "string", "candidate_kind": "string", "marker": "string", "node_path": "string",
        "node_type": "string", "debug_expression": "string", "matched": "boolean", "proposals_count": "int", "generated_count": "int", "fallback_count": "int", "static_count": "int", "noop_count": "int",
    }

    def row(kind: str, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), *(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()))

    def of(kind: str, p: Column, **more: Column) -> Column:
        return row(kind, rule_id=p["rule_id"], candidate_id=p["candidate_id"], candidate_label=p["label"], candidate_kind=p["kind"], **more)

    kept = F.col("accepted")
    counts = ("proposals_count", "generated_count", "fallback_count", "static_count", "noop_count")
    log = F.concat(
        F.transform("evaluated", lambda e: row("RuleEvaluationStarted", rule_id=e["rule_id"])),
        F.transform("observed", lambda o: row("GuardConditionEvaluated", rule_id=o["rule_id"], marker=F.nullif(o["marker"], F.lit("")), node_path=o["path"], node_type=o["type"], debug_expression=o["expression"], matched=o["matched"])),
        F.transform("evaluated", lambda e: row("ProposalsGenerated", rule_id=e["rule_id"], reason=e["reason"], **{c: e[c] for c in counts})),
        F.transform("notes", lambda n: row("ProposalRejected", rule_id=n["rule_id"], reason=n["reason"])),
        F.transform("proposals", lambda p: of("ProposalScored", p)),
        F.transform("accepted", lambda p: of("ProposalAccepted", p)),
        F.transform(F.filter("proposals", lambda p: ~F.exists(kept, lambda k: k == p)), lambda p: of("ProposalRejected", p, reason=F.lit("conflict"))),
        F.transform("accepted", lambda p: of("PatchApplied", p)),
    )
    out = stepped.select("doc_id", F.posexplode(log).alias("seq", "event")).select("doc_id", F.col("seq").cast("long"), "event.*")
    return out.withColumn("event_id", F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "rule_id", F.col("seq").cast("string"))))
