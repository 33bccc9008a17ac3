"""The Markdown rule language: text to rule blocks, on the driver.

A ruleset is a list of `## Kind (modifiers): target` headings, each followed by
sections (`Prefix (any):`, `With:`, ...) of bullets. Comments (`//`) and separators
(`---`) end a block. Any other line is an error that names its place.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field, replace

MATCHING = ("prefix", "postfix", "prompt", "connector")
SECTIONS = (*MATCHING, "scope", "with", "add", "fallback", "options", "rewrite")
MODES = ("any", "all", "none", "incomplete")

_HEADER = re.compile(rf"(?i)({'|'.join(SECTIONS)})[ \t]*(?:\(([^)]*)\))?:(.*)")
_BULLET = re.compile(r"[-*][ \t]+(.+)")
_HEADING = re.compile(r"##([^:(]*)(?:\((.*)\)[^:]*)?:(.*)")
_ITEM = re.compile(r"\(([^)]*)\)\s+(.+)")

# Modifier spellings.
CASE_SENSITIVE = {"case-sensitive", "respect-case", "respect case", "casefold-false", "casefold=false"}
CASE_INSENSITIVE = {"case-insensitive", "ignore-case", "ignore case", "casefold", "casefold-true", "casefold=true"}
WHOLE_WORD = {"word", "whole-word", "whole word"}
AVOID_EDITS = {
    "postfix": ("postfix", 0),
    "prefix clause": ("prefix_clause", 0),
    "matched prefix clause": ("prefix_clause", 0),
    "clause containing anchor to scope end": ("prefix_clause", 0),
    "clause_containing_anchor_to_scope_end": ("prefix_clause", 0),
    "everything": ("everything", 0),
    "all": ("everything", 0),
    "last clause": ("tail_clauses", 1),
    "last sentence": ("tail_sentences", 1),
}


class RulesSyntaxError(ValueError):
    """A ruleset that can't be read, with the place where reading stopped."""

    def __init__(self, message: str, line: int = 1, column: int = 1, snippet: str = ""):
        super().__init__(f"{message} (line {line}, column {column}): {snippet}")
        self.line, self.column, self.snippet = line, column, snippet


@dataclass(frozen=True)
class Options:
    """How a phrase is matched; None leaves the choice to the next level."""

    casefold: bool | None = None
    word: bool | None = None

    def over(self, other: Options) -> Options:
        return Options(
            other.casefold if self.casefold is None else self.casefold, other.word if self.word is None else self.word
        )


DEFAULT_OPTIONS = Options(casefold=True, word=False)


@dataclass(frozen=True)
class Section:
    values: tuple[str, ...] = ()
    options: Options = Options()


@dataclass(frozen=True)
class Rule:
    """One rule after template expansion; sections by name or `name:mode`."""

    rule_id: str
    kind: str
    target: str
    fire: str
    options: Options
    edit: tuple[str, int]
    sections: dict[str, Section] = field(default_factory=dict)

    def values(self, name: str) -> tuple[str, ...]:
        return self.sections.get(name, Section()).values

    def terms(self, name: str, default: str) -> dict[str, tuple[str, ...]]:
        """Phrases of a matching section by mode, the unnamed ones under default."""
        found = {m: self.values(f"{name}:{m}") for m in MODES}
        found[default] = self.values(name) + found[default]
        return found

    def section_options(self, name: str) -> Options:
        last = [s.options for k, s in self.sections.items() if k.partition(":")[0] == name]
        return last[-1] if last else Options()


def _modifiers(text: str | None) -> list[str]:
    return [" ".join(m.lower().split()) for m in (text or "").split(",") if m.strip()]


def match_options(modifiers: list[str], where: str) -> Options:
    casefold = word = None
    for m in modifiers:
        wanted = False if m in CASE_SENSITIVE else True if m in CASE_INSENSITIVE else None
        if wanted is None and m not in WHOLE_WORD:
            raise RulesSyntaxError(f"Unsupported modifier '{m}' in {where}", snippet=m)
        if wanted is None:
            word = True
        elif casefold is (not wanted):
            raise RulesSyntaxError(f"Contradictory modifiers in {where}", snippet=m)
        else:
            casefold = wanted
    return Options(casefold, word)


def item(value: str, where: str) -> tuple[str, Options]:
    """A bullet's phrase and the options written before it."""
    if m := _ITEM.fullmatch(value.strip()):
        return m[2].strip(), match_options(_modifiers(m[1]), where)
    return value, Options()


@dataclass
class _Block:
    title: str
    line: int
    sections: dict[str, Section] = field(default_factory=dict)


def _blocks(text: str) -> list[_Block]:
    blocks: list[_Block] = []
    block: _Block | None = None
    name = ""
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip(" \t\r")
        if not line:
            continue
        if line.startswith("//") or line.startswith("---"):
            block, name = None, ""
        elif line.startswith("##"):
            block, name = _Block(line, number), ""
            blocks.append(block)
        elif block is not None and (m := _HEADER.fullmatch(line)):
            name, options = _section_name(m, number, line)
            inline = m[3].strip()
            block.sections[name] = Section((inline,) if inline else (), options)
        elif block is not None and name and (m := _BULLET.fullmatch(line)):
            held = block.sections[name]
            block.sections[name] = replace(held, values=(*held.values, m[1].strip()))
        else:
            raise RulesSyntaxError("This line fits no part of a rule", number, len(raw) - len(raw.lstrip()) + 1, line)
    return blocks


def _section_name(m: re.Match, number: int, line: str) -> tuple[str, Options]:
    label = m[1].lower()
    modifiers = ["incomplete" if x in ("partial", "missing") else x for x in _modifiers(m[2])]
    modes = {x for x in modifiers if x in MODES}
    matching = [x for x in modifiers if x not in MODES]
    if len(modes) > 1:
        raise RulesSyntaxError("This section asks for more than one mode", number, 1, line)
    if matching and label not in MATCHING:
        raise RulesSyntaxError(f"A {label} section doesn't take '{matching[0]}'", number, 1, line)
    return ":".join([label, *modes]), match_options(matching, f"{label} section")


def _variants(value: str) -> tuple[int, list[str]]:
    """The bar width of a template bullet (0 if it is none) and its variants."""
    parts = re.findall(r"\\.|\|+|[^\\|]+|\\$", value)
    widths = {len(p) for p in parts if p[0] == "|"}
    if len(widths) > 1:
        raise RulesSyntaxError("This template has uneven bars or an empty variant", snippet=value)
    variants = [""]
    for p in parts:
        if p[0] == "|":
            variants.append("")
        else:
            variants[-1] += p[1] if p[0] == "\\" and len(p) > 1 else p
    variants = [v.strip() for v in variants]
    if not all(variants):
        raise RulesSyntaxError("This template has uneven bars or an empty variant", snippet=value)
    return (widths.pop() if widths else 0), variants


def _expanded(block: _Block) -> list[_Block]:
    """One block for each choice: equal widths vary together, different ones cross."""
    found = {k: [_variants(v) for v in s.values] for k, s in block.sections.items()}
    counts: dict[int, int] = {}
    for width, variants in itertools.chain.from_iterable(found.values()):
        if width and counts.setdefault(width, len(variants)) != len(variants):
            raise RulesSyntaxError("Templates of one bar width differ in their number of variants", block.line, 1, block.title)
    out = []
    for picks in itertools.product(*(range(n) for _, n in sorted(counts.items()))):
        pick = dict(zip(sorted(counts), picks, strict=True)) | {0: 0}
        values = {k: tuple(vs[pick[w]] for w, vs in found[k]) for k in found}
        out.append(_Block(block.title, block.line, {k: replace(s, values=values[k]) for k, s in block.sections.items()}))
    return out


def _rule(block: _Block, index: int) -> Rule | None:
    m = _HEADING.fullmatch(block.title)
    kind = " ".join(m[1].lower().split()) if m else ""
    if kind not in ("replace", "after", "avoid", "force"):
        return None  # other headings are skipped, but count for the ids
    for name, section in block.sections.items():
        base = name.partition(":")[0]
        if base not in MATCHING and (bad := [v for v in section.values if _ITEM.fullmatch(v)]):
            raise RulesSyntaxError(f"Items of a {base} section take no modifiers", block.line, 1, bad[0])
    modifiers = _modifiers(m[2])
    fires = {x for x in modifiers if x in ("once", "repeat")}
    if len(fires) > 1:
        raise RulesSyntaxError("A rule can't be both once and repeat", block.line, 1, block.title)
    matching = [x for x in modifiers if x in CASE_SENSITIVE | CASE_INSENSITIVE | WHOLE_WORD]
    edit, chosen = ("everything", 0), False
    for x in modifiers:
        if x in fires or x in matching or kind == "force":
            continue
        tail = re.fullmatch(r"(\d+) (?:last )?(clause|sentence)s?", x)
        if kind != "avoid" or not (tail or x in AVOID_EDITS):
            raise RulesSyntaxError(f"Unsupported modifier '{x}' in {kind.title()} rule header", block.line, 1, block.title)
        if not chosen:
            edit, chosen = (f"tail_{tail[2]}s", int(tail[1])) if tail else AVOID_EDITS[x], True
    if kind == "force" and matching:
        raise RulesSyntaxError("Unsupported matching modifiers in Force rule header", block.line, 1, block.title)
    return Rule(
        rule_id=f"mdr_{index}_{kind}_{hashlib.sha1(block.title.encode()).hexdigest()[:8]}",
        kind=kind,
        target=m[3].strip(),
        fire=fires.pop() if fires else "repeat" if kind == "avoid" else "once",
        options=match_options(matching, f"{kind.title()} rule header"),
        edit=edit,
        sections=block.sections,
    )


def parse_rules(text: str) -> list[Rule]:
    """The rules of a ruleset in order; raises RulesSyntaxError."""
    blocks = [b for block in _blocks(text) for b in _expanded(block)]
    return [r for i, b in enumerate(blocks) if (r := _rule(b, i)) is not None]
