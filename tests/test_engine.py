"""The column engine against the row engine, and known answers of matching and scopes."""

import random

import pytest
from pyspark.sql import functions as F

from glosswright.functions import guards
from glosswright.functions.text import all_spans, first_span, regex, scope_start
from glosswright.operators import editing
from glosswright.plans.dsl import Options, RulesSyntaxError, parse_rules
from glosswright.plans.ir import All, Any, Not, Scope, Term, Then, compile_rules
from glosswright.queries import RULES
from glosswright.streaming import rows

FOLD = Options(True, False)

RULESETS = [
    RULES,
    "## Replace: red\nPrefix (any):\n- the\n- a\nPrefix (none):\n- stop\nWith:\n- blue\n- green\n",
    "## After: dose\nAdd:\n- as needed\n\n## After (case-sensitive): (note)\nAdd:\n- Seen.\n",
    "## After: dose\nOptions:\n- wait for closing: no\nAdd:\n- as needed\n",
    "## Force: end\nAdd:\n- The end.\nScope:\n- 1 sentence\n",
    "## Avoid (postfix): x\nScope:\n- 2 sentences\nPrefix (any):\n- the\n- dose\nPostfix (any):\n- red\n- stop\nPostfix (all):\n- 5-7 mg\nFallback:\n- Nothing.\n- None.\n",
    "## Avoid (prefix clause): x\nPrefix:\n- dose\nConnector:\n- of\nPostfix:\n- red\nFallback:\n- calm\n",
    "## Avoid (last clause): x\nPrompt (any):\n- why\nPostfix:\n- red\nPrefix (incomplete):\n- a\n- zz\nFallback:\n- however, calm\n",
    "## Avoid (2 sentences): x\nPostfix (none):\n- red\nFallback:\n- calm\n",
    "## Avoid: x\nPrefix:\n- the\nFallback:\n- everything new\n",
]


def random_text(rng):
    words = "the a dose of red stop however moreover 5 6 mg 7 mg (note) note ( ) , , . . ! ; \n *b* token and license tion [x ] é ß".split(" ")
    out = ""
    for _ in range(rng.randrange(0, 40)):
        out += rng.choice(words) + rng.choice(["", " ", " ", " ", "  ", "."])
    return out


@pytest.mark.parametrize("rules", RULESETS, ids=range(len(RULESETS)))
def test_engines_agree(spark, rules):
    rng = random.Random(len(rules))
    texts = ["", " ", "the (dose", "dose (of (red) x), the", "(dose). ", "dose)", "dose", "dose )*, red", *(random_text(rng) for _ in range(300))]
    plan = compile_rules(rules)
    docs = spark.createDataFrame([(i, t, "why" if i % 2 else "") for i, t in enumerate(texts)], "doc_id long, text string, prompt_text string")
    for r in editing.step(docs, plan).collect():
        text, kept, notes = rows.step(plan, r.text, r.prompt_text)
        got = [(e.rule_id, e.start, e.stop, e.payload) for e in r.accepted]
        assert (r.new_text, got) == (text, [(e.rule_id, e.start, e.stop, e.payload) for e in kept]), repr(r.text)
        assert {n.rule_id: n.reason for n in r.notes} == notes, repr(r.text)


@pytest.mark.parametrize(
    ("text", "phrase", "options", "span"),
    [
        ("the patient", "ENT", Options(True, False), None),
        ("Urgent ENT evaluation", "ENT", Options(True, False), (7, 10)),
        ("Start corticosteroids now", "steroid", Options(True, False), (13, 20)),
        ("Start corticosteroids now", "steroid", Options(True, True), None),
        ("Start steroid now", "steroid", Options(True, True), (6, 13)),
        ("Use (steroids).", "(steroids)", Options(True, False), (4, 14)),
        ("Use (steroids).", "(steroids).", Options(True, False), (4, 15)),
        ("dose 17 mg", "20-15 mg", Options(True, False), (5, 10)),
        ("\U0001f600 abc", "/b+/", Options(False, False), (3, 4)),
    ],
)
def test_patterns(spark, text, phrase, options, span):
    r = spark.range(1).select(first_span(F.lit(text), phrase, options).alias("s"), all_spans(F.lit(text), regex(phrase, options)).alias("a")).first()
    assert (tuple(r.s) if r.s else None) == span and [tuple(x) for x in r.a][:1] == ([span] if span else [])
    m = rows.pattern(phrase, options).search(text)
    assert (m.span() if m else None) == span


@pytest.mark.parametrize(("text", "ok"), [("a b", True), ("ab", True), ("b a", False), ("b a b", True), ("a b a", True), ("", False)])
def test_ordered(spark, text, ok):
    node = Then(Term("a", FOLD), Term("b", FOLD))
    assert spark.range(1).select(guards.matches(node, F.lit(text))).first()[0] is ok
    assert rows.spans(node, text)[0] is ok


def test_trees_agree(spark):
    rng = random.Random(4)

    def tree(depth):
        kind = rng.choice("tttanoT") if depth else "t"
        if kind == "t":
            return Term(rng.choice("abc"), FOLD)
        if kind == "n":
            return Not(tree(depth - 1))
        if kind == "T":
            return Then(tree(depth - 1), tree(depth - 1))
        return (All if kind == "a" else Any)(tuple(tree(depth - 1) for _ in range(rng.randrange(1, 3))))

    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    nodes = [tree(2) for _ in range(12)]
    cols = [F.struct(guards.matches(n, F.col("text")).alias("h"), guards.locate(n, F.col("text")).matched.alias("m"), guards.locate(n, F.col("text")).spans.alias("s"), guards.touches(n, F.col("text"), F.lit(1), F.lit(3)).alias("t")) for n in nodes]
    for r in df.select("text", F.array(*cols).alias("found")).collect():
        for n, f in zip(nodes, r.found, strict=True):
            ok, spans = rows.spans(n, r.text)
            assert f.h == ok, (n, r.text)
            assert (f.m, [tuple(s) for s in f.s]) == (ok, spans), (n, r.text)
            assert f.t == rows.touches(rows._pruned(n), r.text, (1, 3)), (n, r.text)


@pytest.mark.parametrize("scope", [Scope("tail_sentences", 1), Scope("tail_sentences", 3), Scope("tail_clauses", 1), Scope("tail_clauses", 2, True), Scope("tail_chars", 7), Scope()])
def test_scopes_agree(spark, scope):
    rng = random.Random(8)
    texts = ["", "One. Two. Three", "One. Two. Three.  ", "However, it is", "a\nb, c", "...", *(random_text(rng) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", scope_start(F.col("text"), scope).alias("s")).collect():
        assert r.s == rows.scope_start(r.text, scope), repr(r.text)


def test_sentence_known_answers():
    one = Scope("tail_sentences", 1)
    assert rows.scope_start("One. Two. Three", one) == len("One. Two. ")
    assert rows.scope_start("One. Two. Three.", one) == len("One. Two. ")
    assert rows.scope_start("One. Two.", Scope("tail_sentences", 2)) == 0


def test_parse():
    rules = parse_rules("## Replace: a|b\nWith:\n- x|y\n- u||v\n## Note: skipped\n## Avoid (once, word): t\nFallback: - one\n- two\n")
    assert [(r.target, r.values("with")) for r in rules[:4]] == [("a|b", ("x", "u")), ("a|b", ("x", "v")), ("a|b", ("y", "u")), ("a|b", ("y", "v"))]
    assert rules[4].fire == "once" and rules[4].options.word and rules[4].rule_id.startswith("mdr_5_avoid_")
    assert parse_rules("") == [] and parse_rules("// note\n---\n") == []


@pytest.mark.parametrize(
    "text",
    [
        "prose", "## Replace: a\nprose", "## Replace (once, repeat): a", "## Replace (fast): a", "## Avoid (3 lines): a",
        "## Replace (word): a\nWith (word):\n- b", "## Replace: a\nWith:\n- (word) b", "## Replace: a\nPrefix (any, all):\n- b",
        "## Replace: a\nWith:\n- b|\n", "## Replace: a\nWith:\n- b|c||d\n", "## Replace: a\nWith:\n- b|c\n- d|e|f\n",
        "## Replace (case-sensitive, casefold): a", "## Force (word): a", "- bullet",
    ],
)
def test_syntax_errors(text):
    with pytest.raises(RulesSyntaxError):
        compile_rules(text)


def test_greedy_known_answer(spark):
    spans = {"r1": (0, 5, (-0.2, -0.1, -0.3)), "r2": (3, 7, (-0.05, -0.4, -0.6)), "r3": (4, 6, (-0.15, -0.25, -0.35))}
    items = [(s, r, a, b, "replace", i) for r, (a, b, ss) in spans.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame([(items,)], "p array<struct<score:double,rule_id:string,start:int,stop:int,op:string,candidate_index:int>>")
    kept = df.select(editing.settle(F.col("p")).alias("k")).first().k
    assert [(k.rule_id, k.candidate_index) for k in kept] == [("r2", 0)]
