"""The rule step on one text in plain Python.

Streams keep a document's state in a Python worker and step it token by token; there
the plan of columns doesn't apply. Tests hold both engines against each other.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

from glosswright.functions.text import CLOSING, INTRODUCTIONS, MARKS, OPENING
from glosswright.plans.dsl import Options
from glosswright.plans.ir import All, Any, Not, Plan, RulePlan, Scope, Term, Then

Span = tuple[int, int]

_ENDS = re.compile("[.!?]")


@dataclass(frozen=True)
class Edit:
    score: float
    rule_id: str
    start: int
    stop: int
    candidate_index: int
    payload: str
    candidate_id: str
    label: str


@lru_cache(4096)
def pattern(phrase: str, options: Options) -> re.Pattern:
    flags, stripped = re.I if options.casefold else 0, phrase.strip()
    if len(stripped) > 1 and stripped.startswith("/") and stripped.endswith("/"):
        return re.compile(stripped[1:-1], flags)
    out = ""
    for gap, low, high in re.findall(r"(.*?)(?:(\d+)\s*-\s*(\d+)|$)", phrase, re.S):
        out += re.escape(gap)
        if low:
            out += "(?:" + "|".join(str(n) for n in range(min(int(low), int(high)), max(int(low), int(high)) + 1)) + ")"
    if options.word or re.fullmatch("[A-Z]{2,}", stripped):
        out = (r"\b" if stripped[:1].isalnum() else "") + out + (r"\b" if stripped[-1:].isalnum() else "")
    return re.compile(out, flags)


def spans(node, text: str) -> tuple[bool, list[Span]]:
    """Whether a node matches, and its spans."""
    if isinstance(node, Term):
        found = [m.span() for m in pattern(node.phrase, node.options).finditer(text)]
        return bool(found), found
    if isinstance(node, Not):
        return not spans(node.child, text)[0], []
    if isinstance(node, All | Any):
        parts = [spans(c, text) for c in node.children]
        ok = (all if isinstance(node, All) else any)(p[0] for p in parts)
        return ok, sorted({s for p in parts for s in p[1]}) if ok else []
    left, right = spans(node.left, text)[1], spans(node.right, text)[1]
    found = sorted({(a, d) for a, b in left for c, d in right if b <= c})
    if isinstance(node.left, Then) and isinstance(node.left.right, Any):
        # no alternative of the inner part may begin ahead of what it has to follow
        begins = lambda part: min((a for a, _ in spans(part, text)[1]), default=len(text))
        found = found if begins(node.left.right) >= begins(node.left.left) else []
    return bool(found), found


def holds(node, text: str, prompt: str) -> bool:
    if node is None:
        return True
    if isinstance(node, Then) and node.boundary:
        return spans(node.left, prompt)[0] and spans(node.right, text)[0]
    return spans(node, text)[0]


def touches(node, text: str, edit: Span) -> bool:
    """Whether the part of a guard that must touch the edit does."""
    if isinstance(node, Not):
        return False
    if isinstance(node, Then):
        return touches(node.right, text, edit)
    if isinstance(node, All | Any):
        positive = [touches(c, text, edit) for c in node.children if not isinstance(c, Not)]
        return bool(positive) and (all if isinstance(node, All) else any)(positive)
    return any(a < edit[1] and edit[0] < b for a, b in spans(node, text)[1])


def _pruned(node):
    if isinstance(node, Then):
        return node.right
    return type(node)(tuple(_pruned(c) for c in node.children)) if isinstance(node, All | Any) else node


def scope_start(text: str, scope: Scope) -> int:
    if scope.kind == "tail_chars":
        return max(0, len(text) - scope.n)
    if scope.kind == "whole_doc":
        return 0
    scanned = text.rstrip()
    skip = lambda at: len(text) - len(text[at:].lstrip())
    ends = [m.end() for m in _ENDS.finditer(scanned)]
    n = len(ends) + bool(ends and scanned[ends[-1] :].strip())
    sentences = skip(ends[n - scope.n - 1]) if ends and n > scope.n else 0
    if scope.kind == "tail_sentences":
        return sentences
    starts = [0]
    for i, c in enumerate(scanned):
        if c in ",;:.?!\n" and not (c == "," and re.split(r"[.?!\n]", scanned[:i])[-1].strip().casefold() in INTRODUCTIONS):
            starts.append(i + 1)
    if starts[-1] == len(scanned):
        starts.pop()
    if len(starts) <= 1:
        return sentences
    start = skip(starts[-scope.n] if scope.n < len(starts) else 0)
    if scope.leading_delimiter:
        before = text[:start].rstrip()
        start = len(before) - 1 if before[-1:] and before[-1] in ",;:.?!" else start
    return start


#: Kinds of characters between which no blank is put before, and after, a payload.
_TIGHT_LEFT, _TIGHT_FIRST, _TIGHT_LAST = {"edge", "space", "open", "mark"}, {"space", "close"}, {"space", "open"}


def _kind(c: str) -> str:
    table = (("edge", not c), ("space", c.isspace()), ("open", c in OPENING), ("mark", c in MARKS), ("close", c in CLOSING), ("word", c.isalnum()))
    return next((name for name, fits in table if fits), "other")


def spaced(text: str, start: int, stop: int, payload: str) -> str:
    """payload with the blanks that its neighbours ask for; beside white space it has none of its own."""
    if not payload:
        return payload
    left, first, last, right = map(_kind, (text[max(0, start - 1) : start], payload[0], payload[-1], text[stop : stop + 1]))
    blank = {True: " ", False: ""}
    out = blank[not (left in _TIGHT_LEFT or first in _TIGHT_FIRST)] + payload + blank[right == "word" and last not in _TIGHT_LAST]
    for side, strip in ((left, str.lstrip), (right, str.rstrip)):
        out = strip(out, " ") if side == "space" else out
    return out


def _closing(text: str, depth: int) -> int:
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")" and depth > 0)
        if c == ")" and depth == 0:
            return i
    return -1


def _beside_brackets(text: str, edit: Span, anchor: Span) -> Span | None:
    target, rest = text[anchor[0] : anchor[1]], text[edit[0] : edit[1]]
    depth = target.count("(") - target.count(")")
    behind = lambda at: (end := re.compile(r"[,.!?*]*").match(text, at).end(), end)
    if depth > 0:
        at = _closing(rest, depth)
        return behind(edit[0] + at + 1) if at >= 0 else None
    if rest.count("(") > rest.count(")"):
        return None
    lead = len(rest) - len(rest.lstrip())
    if rest[lead : lead + 1] == ")":
        return behind(edit[0] + lead + 1)
    if "(" in rest:
        first = rest.index("(") + 1
        at = _closing(rest[first:], 1)
        return behind(edit[0] + first + at + 1) if at >= 0 else None
    if rest.isspace() and (m := re.search(r"\)(\s*[.,!?*])?\s*$", text[: edit[0]])):
        at = m.end(1) if m[1] else m.start() + 1
        return at, at
    return edit


def _cased(text: str, edit: Span, candidate: str) -> str:
    if not candidate:
        return candidate
    inside = re.match(r"\s*([,.])", text[edit[0] : edit[1]])
    left = re.search(r"([,.])\s*$", text[: edit[0]])
    mark = inside[1] if inside else left[1] if left else ""
    fix = str.lower if mark == "," else str.upper
    body = re.sub("[A-Za-z]", lambda m: fix(m[0]), candidate, count=1)
    return (mark + " " if inside else " " if left else ". ") + body


def edits_of(rule: RulePlan, text: str, prompt: str, tick: int) -> tuple[list[Edit], str | None]:
    """The edits a rule proposes, or why it proposes none."""
    if tick < rule.skip_tokens:
        return [], "skipped"
    low, edit_low, end = scope_start(text, rule.scope), scope_start(text, rule.edit_scope), len(text)
    view = text[low:]
    if not holds(rule.guard, view, prompt):
        return [], "guard failed"
    anchor: Span | None = None
    edit: Span | None = (edit_low, end)
    if rule.target != "scope_entire":
        found = [m.span() for p, o in rule.anchors if (m := pattern(p, o).search(view))]
        edit = None
        if found:
            a, b = max(found, key=lambda s: (s[1], -s[0]))
            anchor = (a + low, b + low)
        if anchor and anchor[1] > edit_low and anchor[0] < end:
            clause = max([edit_low, *(i + 1 for i in range(edit_low, anchor[0]) if text[i] in ",;:.?!\n")])
            start = {"match_span": anchor[0], "after_anchor": anchor[1], "anchor_clause": clause}[rule.target]
            edit = (max(start, edit_low), anchor[1] if rule.target == "match_span" else end)
    if edit is None:
        return [], "no target span"
    if rule.kind == "after" and rule.wait_for_closing and rule.candidates:
        edit = _beside_brackets(text, edit, anchor)
        if edit is None:
            return [], "waiting_for_closing_parenthesis"
    if rule.kind == "avoid" and rule.guard is not None and not touches(_pruned(rule.guard), view, (edit[0] - low, edit[1] - low)):
        return [], "insufficient overlap actionability"
    if not rule.candidates:
        return [], "no candidates"
    shown = text[edit_low:].casefold()
    if any(c.text and c.text.casefold() in shown for c in rule.candidates):
        return [], "already_satisfied"
    out = []
    for k, c in enumerate(sorted(rule.candidates, key=lambda c: (-c.priority, c.label, c.text))):
        payload = spaced(text, *edit, _cased(text, edit, c.text) if rule.kind == "after" else c.text)
        if text[edit[0] : edit[1]].casefold() != payload.casefold():
            score = -float(end - (edit[1] - edit[0]) + len(payload))
            out.append(Edit(score, rule.rule_id, *edit, k, payload, c.candidate_id, c.label))
    return out, None if out else "already fired"


def clash(a: Edit, b: Edit) -> bool:
    if a.start == a.stop or b.start == b.stop:
        return a.start <= b.stop and b.start <= a.stop
    return a.start < b.stop and b.start < a.stop


def step(plan: Plan, text: str, prompt: str = "", tick: int = 1 << 30) -> tuple[str, list[Edit], dict[str, str]]:
    """The new text, the accepted edits, and the reasons of rules without any."""
    every, notes = [], {}
    for rule in plan.rules:
        found, why = edits_of(rule, text, prompt, tick)
        every += found
        if why:
            notes[rule.rule_id] = why
    low = min((e.start for e in every), default=0)
    kept: list[Edit] = []
    for e in sorted((e for e in every if e.start == low), key=lambda e: (-e.score, e.rule_id, e.start, e.stop, e.candidate_index)):
        if not any(clash(e, k) for k in kept):
            kept.append(e)
    for e in sorted(kept, key=lambda e: (-e.start, e.rule_id, -e.score)):
        text = text[: e.start] + e.payload + text[e.stop :]
    return text, kept, notes


class Watch:
    """From which length on a growing text may give an edit of one rule, so that no step before it is needed.

    It's known for rules that look for plain phrases in the whole text or in its last
    sentences; other rules are asked at every token.
    """

    def __init__(self, rule: RulePlan):
        self.rule = rule
        plain = all(p and not re.search(r"^/.*/$|\d\s*-\s*\d", p.strip(), re.S) for p, _ in rule.anchors)
        self.known = plain and rule.target != "scope_entire" and rule.scope == rule.edit_scope and rule.scope.kind in ("whole_doc", "tail_sentences")
        if self.known and rule.anchors:
            # what follows a word isn't known before the text goes on, so its end is left out
            starts = [("(?i:" if o.casefold else "(?:") + (r"\b" if pattern(p, o).pattern.startswith(r"\b") else "") + re.escape(p) + ")" for p, o in rule.anchors]
            self.starts = re.compile("|".join(starts))
            self.least, self.most = (f(len(p) for p, _ in rule.anchors) for f in (min, max))

    def due(self, whole: str, at: int) -> float:
        """The least length, above `at`, at which whole's beginning may give an edit that it doesn't give at `at`.

        What was proposed at `at` may be proposed again at once.
        """
        if not self.known:
            return at
        if not self.rule.anchors:
            return math.inf
        text, sentences = whole[:at], self.rule.scope.kind == "tail_sentences"
        low = scope_start(text, self.rule.scope)
        if not any(pattern(p, o).search(text, low) for p, o in self.rule.anchors):
            m = self.starts.search(whole, max(0, at + 1 - self.most))
            return max(m.start() + self.least, at + 1) if m else math.inf
        shown = text[low:].casefold()
        if not any(c.text and c.text.casefold() in shown for c in self.rule.candidates):
            return at
        # satisfied as long as the scope starts there
        if not sentences:
            return math.inf
        if text.rstrip()[-1:] in (*".!?", ""):
            return at
        m = _ENDS.search(whole, at)
        return m.end() if m else math.inf


class Replayer:
    """Brings tokens one by one to a text, with a step at each; steps that can't give an edit are left out."""

    def __init__(self, plan: Plan):
        self.plan, self.watches = plan, [Watch(r) for r in plan.rules]

    def __call__(self, text: str, pieces: list[str], ticks: int, edits: int, tried: set[str]) -> tuple[str, int, int, set[str]]:
        """Text, ticks, edits and marks after the pieces."""
        whole, shift = text + "".join(pieces), 0
        ends = list(accumulate(map(len, pieces), initial=len(text)))
        counts = list(accumulate((p != "" for p in pieces), initial=ticks))
        taken, due = 0, [-1.0] * len(self.watches)
        while taken < len(pieces):
            at = ends[taken] + shift
            due = [d if d > at else w.due(whole, at) for d, w in zip(due, self.watches, strict=True)]
            taken = max(bisect_left(ends, min(due, default=math.inf) - shift), taken + 1)
            if taken > len(pieces):
                break
            text = whole[: ends[taken] + shift]
            after, kept, _ = step(self.plan, text, tick=counts[taken])
            marks = {hashlib.sha256(f"{e.start}:{e.stop}:{len(e.payload)}:{e.payload}{text[: e.start]}".encode()).hexdigest() for e in kept}
            if kept and not marks <= tried:
                tried = tried | marks
                whole, edits = after + whole[len(text) :], edits + len(kept)
                shift += len(after) - len(text)
                due = [-1.0] * len(self.watches)
        return whole, counts[-1], edits, tried
