"""Text primitives as Columns: patterns, spans, scopes, spacing.

Offsets are code points from 0, half open. Nothing here needs Python on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswright.plans.dsl import Options
from glosswright.plans.ir import Scope

#: What counts as white space beyond \s, in a character class.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPANS = "array<struct<start:int,stop:int>>"
#: Matches that one fold gathers.
FOLD_BLOCK = 256

# Leaders whose comma opens no clause, and characters that stick to text.
INTRODUCTIONS = ("however", "therefore", "moreover", "furthermore", "instead", "meanwhile")
CLOSING, OPENING, MARKS = ".,;:!?)]}", "([{", "*_`~"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def regex(phrase: str, options: Options) -> str:
    """The Java pattern of a phrase: /regex/, or a literal with numeric ranges."""
    stripped = phrase.strip()
    flags = "(?iu)" if options.casefold else ""
    if len(stripped) >= 2 and stripped[0] == stripped[-1] == "/":
        pattern = stripped[1:-1]
        if re.search(r"\(\?P|\\Z", pattern) or re.compile(pattern).match(""):
            raise ValueError(f"this regular expression can't be used: {phrase}")
        return flags + pattern

    def numbers(m: re.Match) -> str:
        low, high = sorted((int(m[1]), int(m[2])))
        return "(?:" + "|".join(map(str, range(low, high + 1))) + ")"

    parts = re.split(r"(\d+\s*-\s*\d+)", phrase)
    body = "".join(re.sub(r"(\d+)\s*-\s*(\d+)", numbers, p) if i % 2 else re.escape(p) for i, p in enumerate(parts))
    if options.word or re.fullmatch("[A-Z]{2,}", stripped):
        flags = "(?iuU)" if options.casefold else "(?U)"
        body = (r"(?<!\w)" if stripped[:1].isalnum() else "") + body + (r"(?!\w)" if stripped[-1:].isalnum() else "")
    return flags + body


def contains_phrase(text: Column, phrase: str, options: Options) -> Column:
    """Whether the phrase occurs; a plain substring test where that is enough."""
    plain = not options.casefold and regex(phrase, options) == re.escape(phrase)
    return F.contains(text, F.lit(phrase)) if plain else F.rlike(text, F.lit(regex(phrase, options)))


def first_span(text: Column, phrase: str, options: Options) -> Column:
    """The first occurrence as struct(start, stop), or null."""
    rx = regex(phrase, options)
    size = F.length(F.regexp_extract(text, rx, 0))
    # regexp_instr would count UTF-16 units, so the gap before the match gives the place
    span = lambda at: F.when(size > 0, F.struct(at.alias("start"), (at + size).alias("stop")))
    return let(F.length(F.get(F.split(text, rx, 2), F.lit(0))), span)


def all_spans(text: Column, rx: str | Column) -> Column:
    """All occurrences from left to right: gaps and matches add up to the offsets."""
    rx = F.lit(rx) if isinstance(rx, str) else rx
    found, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rx, -1)
    sizes = lambda f: F.zip_with(F.slice(gaps, F.lit(1), F.size(f)), f, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    return let(found, lambda f: F.when(F.size(f) > 0, let(sizes(f), _offsets)).otherwise(F.array().cast(SPANS)))


def _offsets(sizes: Column) -> Column:
    """The spans of consecutive matches, given each one's gap and length.

    A fold copies the list that it builds at every step, so it builds short ones, of
    FOLD_BLOCK matches from 0 on, and these are moved by their blocks' offsets.
    """
    none = F.array().cast(SPANS)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        stop = start + pair["hit"]
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("out"))

    def block(i: Column) -> Column:
        return F.aggregate(F.slice(sizes, i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def joined(blocks: Column) -> Column:
        move = lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))
        bases = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases")), move)["bases"]
        moved = lambda b, base: F.transform(b["out"], lambda s: F.struct((s["start"] + base).alias("start"), (s["stop"] + base).alias("stop")))
        return F.flatten(F.zip_with(blocks, bases, moved))

    last = F.floor((F.size(sizes) - 1) / FOLD_BLOCK).cast("int")
    return let(F.transform(F.sequence(F.lit(0), last), block), joined)


def tail(text: Column, start: Column) -> Column:
    return F.substring(text, start + 1, F.length(text))


def slice_text(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def _skip_space(text: Column, start: Column) -> Column:
    return let(start, lambda at: at + F.length(F.regexp_extract(tail(text, at), f"^[{SPACE}]*", 0)))


def _cut(pieces: Column, n: Column) -> Column:
    """Characters of the first n pieces."""
    return F.length(F.array_join(F.slice(pieces, F.lit(1), n), ""))


def scope_start(text: Column, scope: Scope) -> Column:
    """Where the scope begins; it always reaches to the end of the text."""
    if scope.kind == "tail_chars":
        return F.greatest(F.lit(0), F.length(text) - scope.n)
    if scope.kind == "whole_doc":
        return F.lit(0)
    scanned = F.regexp_replace(text, f"(?<![{SPACE}])[{SPACE}]+$", "")
    if scope.kind == "tail_sentences":
        return _sentences(text, scanned, scope.n)
    intro = rf"(?i)(?<!(?:^|[.?!\n])\s{{0,8}}(?:{'|'.join(INTRODUCTIONS)})\s{{0,8}},)"
    clauses = F.filter(F.split(scanned, rf"(?<=[;:.?!\n])|(?<=,){intro}", -1), lambda p: p != "")

    def start(pieces: Column) -> Column:
        count = F.size(pieces)
        at = _skip_space(text, F.when(count > scope.n, _cut(pieces, F.greatest(count - scope.n, F.lit(0)))).otherwise(F.lit(0)))
        if scope.leading_delimiter:
            at = let(at, lambda x: x - F.length(F.regexp_extract(F.substring(text, F.lit(1), x), f"[,;:.?!][{SPACE}]*$", 0)))
        return F.when(count <= 1, _sentences(text, scanned, scope.n)).otherwise(at)

    return let(clauses, start)


def _sentences(text: Column, scanned: Column, n: int) -> Column:
    """Every . ! ? ends a sentence, and what follows the last one is a sentence, too."""
    pieces = F.filter(F.split(scanned, "(?<=[.!?])", -1), lambda p: p != "")

    def start(pieces: Column) -> Column:
        # a last piece of blanks can't be: the scanned text has none at its end
        some = (F.size(pieces) > n) & F.rlike(F.get(pieces, F.lit(0)), F.lit("[.!?]$"))
        return F.when(some, _skip_space(text, _cut(pieces, F.greatest(F.size(pieces) - n, F.lit(0))))).otherwise(F.lit(0))

    return let(pieces, start)


def clause_start(text: Column, at: Column, low: Column) -> Column:
    """The start of the clause that holds `at`, no earlier than low."""
    return low + F.length(F.regexp_extract(slice_text(text, low, at), r"(?s)^.*[,;:.?!\n]", 0))


def sentence_floor(text: Column, start: Column, stop: Column) -> Column:
    """The start of the last sentence inside a span."""

    def floor(inside: Column) -> Column:
        at = F.length(F.regexp_extract(inside, rf"(?s)^.*[.!?\n][{SPACE}]*", 0))
        return let(at, lambda x: F.when((x > 0) & (x < F.length(inside)), start + x).otherwise(start))

    return let(slice_text(text, start, stop), floor)


def folded(text: Column) -> Column:
    """For comparisons without case: lower case, and what full folding makes of ß."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def spaced(text: Column, start: Column, stop: Column, payload: Column) -> Column:
    """payload with the blanks that its neighbours in the text ask for."""
    quoted = lambda chars: "[" + re.escape(chars) + "]"
    left = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(F.lit(""))
    right = F.substring(text, stop + 1, F.lit(1))
    space, first, last = f"^[{SPACE}]$", F.left(payload, F.lit(1)), F.right(payload, F.lit(1))
    is_ = lambda c, rx: F.rlike(c, F.lit(rx))
    before = (left != "") & ~is_(left, space) & ~is_(first, space) & ~is_(left, quoted(OPENING + MARKS)) & ~is_(first, quoted(CLOSING))
    after = is_(right, r"^[\p{L}\p{N}]$") & ~is_(last, space) & ~is_(last, quoted(OPENING))
    out = F.concat(F.when(before, " ").otherwise(""), payload, F.when(after, " ").otherwise(""))
    out = F.when(is_(left, space), F.regexp_replace(out, "^ +", "")).otherwise(out)
    out = F.when(is_(right, space), F.regexp_replace(out, " +$", "")).otherwise(out)
    return F.when(payload == "", payload).otherwise(out)


def version(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def slug(text: Column, index: Column) -> Column:
    """`007-some-name`: a number and the name's letters and digits."""
    name = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("-"), F.regexp_replace(name, "^-+|-+$", ""))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
