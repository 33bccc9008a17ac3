"""Gold predicates: boolean text conditions, parsed to programs that a Column runs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"|([^\s()"]+))')


class GoldSyntaxError(ValueError):
    pass


def _tokens(line: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while line[at:].strip():
        m = _TOKEN.match(line, at)
        if not m:
            raise GoldSyntaxError(f"can't read: {line[at:]}")
        at = m.end()
        word = m[4]
        if m[1] or m[2]:
            out.append((m[1] or m[2], ""))
        elif word and word.upper() in ("AND", "OR", "NOT"):
            out.append((word.upper(), ""))
        else:
            out.append(("term", m[3] if word is None else word))
    return out


def parse_gold(gold: str):
    """A tree of ("and"|"or", parts), ("not", part) and ("term", text); None if empty.

    Lines are joined by AND, a leading `-` is a bullet; OR binds looser than AND.
    """
    lines = [re.sub(r"^-\s*", "", x.strip()) for x in (gold or "").splitlines()]
    trees = [_line(x) for x in lines if x]
    return None if not trees else trees[0] if len(trees) == 1 else ("and", trees)


def _line(line: str):
    tokens = [*_tokens(line), ("end", "")]
    at = 0

    def chain(word: str, part):
        nonlocal at
        parts = [part()]
        while tokens[at][0] == word:
            at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else (word.lower(), parts)

    def either():
        return chain("OR", lambda: chain("AND", negated))

    def negated():
        nonlocal at
        kind, text = tokens[at]
        at += 1
        if kind == "NOT":
            return ("not", negated())
        if kind == "term":
            return ("term", text)
        if kind == "(":
            inner = either()
            if tokens[at][0] != ")":
                raise GoldSyntaxError(f"missing ')' in: {line}")
            at += 1
            return inner
        raise GoldSyntaxError(f"unexpected {kind!r} in: {line}")

    tree = either()
    if tokens[at][0] != "end":
        raise GoldSyntaxError(f"trailing {tokens[at]} in: {line}")
    return tree


def holds(tree, answer: Column) -> Column:
    """Whether the answer meets one parsed predicate."""
    return meets(F.array(*map(F.lit, _postfix(tree))).cast("array<string>"), answer)


def program(gold: str) -> list[str]:
    """The predicate in postfix: "=term", and "!", "&", "|" for what stands before them."""
    return _postfix(parse_gold(gold))


def _postfix(tree) -> list[str]:

    def walk(tree) -> list[str]:
        kind, part = tree
        if kind == "term":
            return [f"={part}"]
        if kind == "not":
            return [*walk(part), "!"]
        out = walk(part[0])
        for p in part[1:]:
            out += [*walk(p), "&" if kind == "and" else "|"]
        return out

    return [] if tree is None else walk(tree)


def meets(steps: Column, answer: Column) -> Column:
    """Whether the answer meets a program; terms are substrings without case.

    One expression of constant size runs every program: a fold with a stack.
    """

    def step(stack: Column, x: Column) -> Column:
        n = F.size(stack)
        last, second = F.get(stack, n - 1), F.get(stack, n - 2)
        push = lambda k, v: F.concat(F.slice(stack, F.lit(1), F.greatest(n - k, F.lit(0))), F.array(v))
        return (
            F.when(F.startswith(x, F.lit("=")), push(0, F.contains(F.lower(answer), F.lower(F.substring(x, 2, 1 << 30)))))
            .when(x == "!", push(1, ~last))
            .when(x == "&", push(2, second & last))
            .otherwise(push(2, second | last))
        )

    return F.coalesce(F.get(F.aggregate(steps, F.array().cast("array<boolean>"), step), F.lit(0)), F.lit(True))
