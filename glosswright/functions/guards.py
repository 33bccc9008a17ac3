"""Guards: the boolean span algebra of a rule, lowered to Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswright.functions.text import SPANS, all_spans, contains_phrase, let, regex
from glosswright.plans.ir import All, Any, Not, Term, Then, terms_of


@dataclass
class Found:
    """Whether a node matched, and where; overlap lists its children for actionability."""

    node: object
    matched: Column
    spans: Column
    children: tuple = ()


def _none() -> Column:
    return F.array().cast(SPANS)


def _sorted(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(spans))


def matches(node, text: Column, prompt: Column | None = None) -> Column:
    """Whether a guard holds.

    Terms outside an order need no spans, only a search. In an order, spans of each
    distinct term are computed once, and a chain is followed by earliest ends.
    """
    if node is None:
        return F.lit(True)
    if isinstance(node, Term):
        return contains_phrase(text, node.phrase, node.options)
    if isinstance(node, Not):
        return ~matches(node.child, text)
    if isinstance(node, Then):
        if node.boundary:
            return matches(node.left, prompt) & matches(node.right, text)
        terms = list(dict.fromkeys((t.phrase, t.options) for t in terms_of(node)))
        spans = F.array(*(all_spans(text, regex(p, o)) for p, o in terms))
        return let(spans, lambda sp: _Chain(terms, sp).holds(node))
    out = matches(node.children[0], text)
    for c in node.children[1:]:
        out = out & matches(c, text) if isinstance(node, All) else out | matches(c, text)
    return out


@dataclass
class _Chain:
    """Follows ordered nodes over the spans of their terms."""

    terms: list
    held: Column

    def spans(self, node: Term) -> Column:
        return F.get(self.held, F.lit(self.terms.index((node.phrase, node.options))))

    def holds(self, node) -> Column:
        if isinstance(node, Term):
            return F.size(self.spans(node)) > 0
        if isinstance(node, Not):
            return ~self.holds(node.child)
        if isinstance(node, Then):
            return self.reach(node, F.lit(0)).isNotNull()
        out = self.holds(node.children[0])
        for c in node.children[1:]:
            out = out & self.holds(c) if isinstance(node, All) else out | self.holds(c)
        return out

    def reach(self, node, low: Column) -> Column:
        """The earliest end of a match that starts at low or later; null if there is none."""
        if isinstance(node, Term):
            later = lambda at: F.array_min(F.transform(F.filter(self.spans(node), lambda s: s["start"] >= at), lambda s: s["stop"]))
            return let(low, later)
        if isinstance(node, Not):
            return F.lit(None).cast("int")
        if isinstance(node, Then):
            end = self.reach(node.right, self.reach(node.left, low))
            if isinstance(node.left, Then) and isinstance(node.left.right, Any):
                # of a chain a -> (b or c) -> d, no b or c may come before the first a
                first, middle = self.start(node.left.left), self.start(node.left.right)
                end = F.when(F.coalesce(middle >= first, F.lit(True)), end)
            return end
        ends = F.array_min(F.array(*(self.reach(c, low) for c in node.children)))
        return F.when(self.holds(node), ends)

    def start(self, node) -> Column:
        """The earliest start of a match; null if there is none."""
        if isinstance(node, Term):
            return F.array_min(self.spans(node))["start"]
        if isinstance(node, Not):
            return F.lit(None).cast("int")
        if isinstance(node, Then):
            # any start of left counts whose end lies before a match of right
            return F.when(self.holds(node), self.start(node.left))
        starts = F.array_min(F.array(*(self.start(c) for c in node.children)))
        return F.when(self.holds(node), starts)


def locate(node, text: Column) -> Found:
    """Evaluates a node with its spans on one text."""
    if isinstance(node, Term):
        spans = all_spans(text, regex(node.phrase, node.options))
        return Found(node, F.size(spans) > 0, spans)
    if isinstance(node, Not):
        child = locate(node.child, text)
        return Found(node, ~child.matched, _none(), (child,))
    if isinstance(node, All | Any):
        children = tuple(locate(c, text) for c in node.children)
        matched = children[0].matched
        for c in children[1:]:
            matched = matched & c.matched if isinstance(node, All) else matched | c.matched
        spans = _sorted(F.concat(*(c.spans for c in children)))
        return Found(node, matched, F.when(matched, spans).otherwise(_none()), children)
    left, right = locate(node.left, text), locate(node.right, text)
    after = lambda a: F.transform(F.filter(right.spans, lambda b: b["start"] >= a["stop"]), lambda b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))
    spans = _sorted(F.flatten(F.transform(left.spans, after)))
    if isinstance(node.left, Then) and isinstance(node.left.right, Any):
        # of a chain a -> (b or c) -> d, no b or c may come before the first a
        anchors, middle = left.children[0].spans, left.children[1].spans
        spans = F.when(F.array_min(middle)["start"] < F.array_min(anchors)["start"], _none()).otherwise(spans)
    return Found(node, F.size(spans) > 0, spans, (left, right))


def _subtree(node):
    """What of a guard must touch the edit: the right side of an order."""
    if isinstance(node, Then):
        return node.right
    if isinstance(node, All | Any):
        return type(node)(tuple(_subtree(c) for c in node.children))
    return node


def touches(node, text: Column, start: Column, stop: Column) -> Column:
    """Actionability of an Avoid guard for the edit [start, stop) of text."""
    return F.lit(True) if node is None else _touches(_subtree(node), text, start, stop)


def _touches(node, text: Column, start: Column, stop: Column) -> Column:
    if isinstance(node, Not):
        return F.lit(False)
    if isinstance(node, Then):
        return _touches(node.right, text, start, stop)
    if isinstance(node, All | Any):
        positive = [_touches(c, text, start, stop) for c in node.children if not isinstance(c, Not)]
        out = positive[0] if positive else F.lit(False)
        for p in positive[1:]:
            out = out & p if isinstance(node, All) else out | p
        return out
    return F.exists(all_spans(text, regex(node.phrase, node.options)), lambda s: (s["start"] < stop) & (start < s["stop"]))


def observations(node, text: Column, prompt: Column, path: str = "guard") -> list[Column]:
    """struct(path, type, marker, expression, matched) of every node, parents first."""
    side = prompt if isinstance(node, Then) and node.boundary else text
    kind = type(node).__name__
    own = F.struct(
        F.lit(path).alias("path"),
        F.lit(kind).alias("type"),
        F.lit(getattr(node, "marker", None)).cast("string").alias("marker"),
        F.lit(node.phrase if isinstance(node, Term) else kind).alias("expression"),
        matches(node, text, prompt).alias("matched"),
    )
    children = node.children if isinstance(node, All | Any) else (node.child,) if isinstance(node, Not) else (node.left, node.right) if isinstance(node, Then) else ()
    out = [own]
    for i, c in enumerate(children):
        out += observations(c, side if i == 0 else text, prompt, f"{path}.{i}")
    return out
