"""The plan of a ruleset: what each rule matches, where it edits, what it proposes."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from glosswright.plans.dsl import DEFAULT_OPTIONS, MODES, Options, Rule, item, parse_rules

TAIL_CHARS = 800


@dataclass(frozen=True)
class Term:
    phrase: str
    options: Options
    marker: str = ""


@dataclass(frozen=True)
class All:
    children: tuple


@dataclass(frozen=True)
class Any:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Then:
    """left before right; boundary: left is looked for in the prompt instead."""

    left: object
    right: object
    boundary: bool = False


@dataclass(frozen=True)
class Scope:
    kind: str = "whole_doc"  # or tail_chars, tail_sentences, tail_clauses
    n: int = 0
    leading_delimiter: bool = False


@dataclass(frozen=True)
class Candidate:
    candidate_id: str
    text: str
    kind: str  # static or fallback
    priority: int
    label: str


@dataclass(frozen=True)
class RulePlan:
    rule_id: str
    name: str
    kind: str
    fire: str
    scope: Scope
    edit_scope: Scope
    guard: object | None
    anchors: tuple[tuple[str, Options], ...]
    target: str  # scope_entire, match_span, after_anchor, anchor_clause
    candidates: tuple[Candidate, ...]
    wait_for_closing: bool = True
    skip_tokens: int = 0
    policy: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    rules: tuple[RulePlan, ...]


def all_of(nodes: list):
    """The conjunction of nodes, flattened; None of none."""
    flat = [c for n in nodes if n is not None for c in (n.children if isinstance(n, All) else (n,))]
    return None if not flat else flat[0] if len(flat) == 1 else All(tuple(flat))


def _scope(bullets: tuple[str, ...]) -> Scope:
    for b in (" ".join(x.lower().split()) for x in bullets):
        if b in ("all", "from beginning", "from the beginning", "from the start"):
            return Scope()
        lead = b.split()[0] if b.split() and b.split()[0].isdigit() else "1"
        if "clause" in b:
            return Scope("tail_clauses", int(lead) or 1)
        if "sentence" in b:
            return Scope("tail_sentences", int(lead) or 1)
        if "char" in b:
            numbers = [x for x in b.split() if x.isdigit()]
            return Scope("tail_chars", int(numbers[0]) if numbers else TAIL_CHARS)
    return Scope()


class _Terms:
    """Builds the conditions of one rule's sections."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def terms(self, section: str, mode: str, values: tuple[str, ...]) -> tuple[Term, ...]:
        out = []
        for v in values:
            phrase, own = item(v, f"{section} item")
            options = own.over(self.rule.section_options(section)).over(self.rule.options).over(DEFAULT_OPTIONS)
            out.append(Term(phrase, options, f"{section}_{mode}" if mode else section))
        return tuple(out)

    def condition(self, section: str, mode: str, values: tuple[str, ...]):
        if not values:
            return None
        terms = self.terms(section, mode, values)
        return {
            "any": Any(terms),
            "all": all_of(list(terms)),
            "none": Not(Any(terms)),
            "incomplete": Not(all_of(list(terms)) if len(terms) == 1 else All(terms)),
        }[mode]

    def gate(self):
        """Guard of Replace and After: prefix only, without `incomplete`."""
        found = self.rule.terms("prefix", "any")
        return all_of([self.condition("prefix", m, found[m]) for m in MODES if m != "incomplete"])

    def avoid_guard(self):
        """Prefixes before the connector and postfixes, what must be absent, and the prompt."""
        prefix, postfix = self.rule.terms("prefix", "all"), self.rule.terms("postfix", "all")
        connector = self.terms("connector", "", self.rule.values("connector"))
        chain = [Any(connector)] if connector else []
        chain += [c for m in MODES if (c := self.condition("postfix", m, postfix[m])) is not None]
        tail = None
        for link in chain:
            tail = link if tail is None else Then(tail, link)
        ordered = []
        if tail is not None:
            if prefix["any"]:
                ordered.append(Any(tuple(Then(t, tail) for t in self.terms("prefix", "any", prefix["any"]))))
            if prefix["all"]:
                ordered.append(all_of([Then(t, tail) for t in self.terms("prefix", "all", prefix["all"])]))
            ordered = ordered or [tail]
        absent = [self.condition("prefix", m, prefix[m]) for m in ("none", "incomplete")]
        answer = all_of([*absent, all_of(ordered)])
        prompt = self.rule.terms("prompt", "all")
        asked = all_of([self.condition("prompt", m, prompt[m]) for m in MODES])
        return Then(asked, answer, boundary=True) if asked is not None and answer is not None else answer or asked


def terms_of(node) -> list[Term]:
    if node is None:
        return []
    if isinstance(node, Term):
        return [node]
    children = node.children if isinstance(node, All | Any) else (node.child,) if isinstance(node, Not) else (node.left, node.right)
    return [t for c in children for t in terms_of(c)]


# Spellings of the numeric options.
_OPTION_NAMES = {
    "probe_num_beams": ("num_beams", "beams", "beam_width", "width", "k", "trajectories", "max trajectories", "max_trajectories"),
    "probe_max_new_tokens": ("max_new_tokens", "probe_max_new_tokens", "tokens", "token_count"),
    "min_prob_ratio_to_best": ("min probability ratio", "min_prob_ratio_to_best"),
    "skip": ("skip",),
}


def _numeric_options(bullets: tuple[str, ...]) -> dict[str, float]:
    names = {alias: name for name, aliases in _OPTION_NAMES.items() for alias in aliases}
    out: dict[str, float] = {}
    for b in bullets:
        key, colon, raw = b.partition(":")
        name = names.get(key.strip().lower())
        if colon and name and re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?", raw.strip(), re.I):
            out[name] = float(raw) if name.startswith("min") else int(float(raw))
    return out


# Spellings of the options that say whether an edit waits for a closing parenthesis.
_REGIME_KEYS = ("regime", "fire regime", "parenthesis regime")
_FLAG_KEYS = ("wait for closing", "wait for closing parenthesis")
_REGIMES = {True: ("fire after closing", "wait for closing", "wait", "default"), False: ("don't wait for closing", "dont wait for closing", "no wait")}
_FLAGS = {True: ("true", "yes", "1", "on"), False: ("false", "no", "0", "off")}
_WAITS = {
    (key, value): wait
    for keys, spellings in ((_REGIME_KEYS, _REGIMES), (_FLAG_KEYS, _FLAGS))
    for key in keys
    for wait, values in spellings.items()
    for value in values
}


def _waits(bullets: tuple[str, ...]) -> bool:
    """The last bullet that is in the table decides; without one the edit waits."""
    flat = lambda s: " ".join(s.lower().replace("_", " ").split())
    known = [_WAITS[k] for b in bullets if (k := tuple(map(flat, b.partition(":")[::2]))) in _WAITS]
    return known[-1] if known else True


def _candidates(prefix: str, texts: tuple[str, ...], kind: str = "static") -> tuple[Candidate, ...]:
    fallback = kind == "fallback"
    return tuple(
        Candidate(f"{prefix}_{i}", t, kind, 11 - i if fallback else 10, f"{prefix}_{i}" if fallback else t)
        for i, t in enumerate(texts, 1)
    )


def _plan(rule: Rule) -> RulePlan:
    scope, build = _scope(rule.values("scope")), _Terms(rule)
    options = rule.options.over(DEFAULT_OPTIONS)
    edit_scope, guard, anchors, target, wait, policy = scope, None, (), "scope_entire", True, {}
    if rule.kind == "replace":
        guard, anchors, target = build.gate(), ((rule.target, options),), "match_span"
        candidates = _candidates("rewrite", rule.values("with"))
    elif rule.kind == "after":
        bases = [rule.target, *([] if not rule.target or rule.target[0] == "(" else [f"({rule.target})", f"({rule.target}"])]
        phrases = dict.fromkeys(b + end for b in bases for end in (".", ",", ""))
        guard, anchors, target = build.gate(), tuple((p, options) for p in phrases), "after_anchor"
        candidates, wait = _candidates("insert", rule.values("add")), _waits(rule.values("options"))
    elif rule.kind == "force":
        candidates = _candidates("force", rule.values("add"))
    else:
        guard, policy = build.avoid_guard(), _numeric_options(rule.values("options"))
        candidates = _candidates("fallback", rule.values("fallback"), "fallback")
        edit, n = rule.edit
        if edit.startswith("tail_"):
            edit_scope = Scope(edit, n or 1, leading_delimiter=edit == "tail_clauses")
        elif edit != "everything":
            marked = tuple(f"{edit.partition('_')[0]}_{m}" for m in ("all", "any"))
            anchors = tuple(dict.fromkeys((t.phrase, t.options) for t in terms_of(guard) if t.marker in marked))
            target = "anchor_clause" if anchors else target
    digest = hashlib.sha1(json.dumps(asdict(rule), sort_keys=True).encode()).hexdigest()[:10]
    return RulePlan(
        f"ng-{rule.rule_id}-{digest}", f"{rule.kind}:{rule.target}", rule.kind, rule.fire, scope, edit_scope, guard,
        anchors, target, candidates, wait, int(policy.get("skip", 0)), policy,
    )


def compile_rules(text: str) -> Plan:
    """Parses and compiles a ruleset."""
    return Plan(tuple(_plan(r) for r in parse_rules(text)))
