"""Evaluation, telemetry, sources, sinks and streams on small known answers."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glosswright.operators import evaluation, telemetry
from glosswright.plans.gold import GoldSyntaxError, holds, parse_gold
from glosswright.plans.ir import compile_rules
from glosswright.sources import cases, sinks
from glosswright.streaming import replay, rows

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("gold", "answer", "ok"),
    [
        ("- steroid AND NOT antibiotic", "Start Steroids", True),
        ("a OR b AND c", "a", True),
        ('"hearing loss" AND sudden', "sudden hearing loss", True),
        ("x\ny", "x", False),
        ("", "anything", True),
        ("(a OR b) AND c", "a", False),
        ('NOT NOT "and"', "sand", True),
    ],
)
def test_gold(spark, gold, answer, ok):
    assert spark.range(1).select(holds(parse_gold(gold), F.lit(answer))).first()[0] is ok
    graded = evaluation.grade(spark.createDataFrame([(answer, gold), (None, gold)], "answer string, gold string"))
    assert [r.ok for r in graded.collect()][0] is ok


@pytest.mark.parametrize("gold", ["foo bar", "a AND", "(a", "a)", "NOT"])
def test_gold_errors(gold):
    with pytest.raises(GoldSyntaxError):
        parse_gold(gold)


def test_grade_many_predicates(spark):
    df = spark.range(10_000).selectExpr("concat('w', id) as answer", "concat('w', id % 7000, ' OR \"', id, ' x\"') as gold")
    graded = evaluation.grade(df)
    assert graded.filter("ok").count() == sum(f"w{i % 7000}" in f"w{i}" for i in range(10_000))
    plan = graded._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000
    with pytest.raises(Exception, match="trailing"):
        evaluation.grade(spark.createDataFrame([("a", "foo bar")], "answer string, gold string")).collect()


def test_spans_of_many_matches(spark):
    from glosswright.functions.text import all_spans

    text = "ab " * 32_000
    row = spark.createDataFrame([(text,), ("",), ("ab",)], "t string").select(all_spans(F.col("t"), "ab")).collect()
    assert [(s.start, s.stop) for s in row[0][0]] == [(3 * i, 3 * i + 2) for i in range(32_000)]
    assert row[1][0] == [] and [tuple(s) for s in row[2][0]] == [(0, 2)]


def _runs(spark, rows_):
    return spark.createDataFrame(rows_, "id string, case_type string, ok boolean, pos int")


def test_pairs(spark):
    a = _runs(spark, [("1", "x", True, 0), ("2", "x", True, 0), ("2", "x", False, 1)])
    b = _runs(spark, [("1", "x", False, 0), ("2", "x", True, 0)])
    r = evaluation.transitions(evaluation.paired(a, b)).first()
    assert (r.cc, r.ci, r.ic, r.ii, r.delta) == (0, 1, 1, 0, 0.0)
    with pytest.raises(Exception, match="different case ids"):
        evaluation.paired(a, b.filter("id = '1'")).collect()
    with pytest.raises(Exception, match="different case ids"):
        evaluation.transitions(evaluation.paired(a, b.filter("id = '1'"))).collect()
    ungraded = b.withColumn("ok", F.when(F.col("id") == "2", F.col("ok")))
    assert evaluation.transitions(evaluation.paired(a, ungraded)).first().n == 2
    assert evaluation.paired_n(a, b.filter("id = '1'"), "case_type").first().paired_n == 1 and evaluation.common_ids(a, b).count() == 2
    assert evaluation.append(a, b.drop("pos")).count() == 5
    filled = evaluation.with_defaults(spark.createDataFrame([("x",), ("y",)], "case_type string"), spark.createDataFrame([("x", 3)], "case_type string, n int"))
    assert sorted(map(tuple, filled.collect())) == [("x", 3), ("y", 0)]
    assert evaluation.transitions(evaluation.paired(a.limit(0), b.limit(0))).count() == 1


def test_winners(spark):
    scores = {1: [0, -0.1, -4], 2: [float("-inf")] * 2, 3: [0, -10000.0], 4: [0, -0.1], 5: [float("nan"), -1.0]}
    df = spark.createDataFrame([(g, i, float(s)) for g, ss in scores.items() for i, s in enumerate(ss)], "g int, candidate_index int, score double")
    assert {r.g: r.candidate_index for r in evaluation.winners(df, 1.05, "g").collect()} == {1: 0, 3: 0, 4: 0, 5: 1}
    assert {r.g for r in evaluation.winners(df, 1.2, "g").collect()} == {3, 5}
    assert {r.ratio_to_best for r in evaluation.ranked(df, "g").filter("g = 2").collect()} == {0.0}


def test_coverage(spark):
    df = spark.createDataFrame([("A", 10, 3, False), ("B", 8, 8, True)], "episode_id string, generated int, popped int, exhausted boolean")
    assert tuple(evaluation.coverage_budget(df).first()) == (3, 9)
    assert tuple(evaluation.coverage_budget(df.limit(0)).first()) == (None, None)


def test_balanced(spark):
    df = spark.createDataFrame([("v", "a", True), ("v", "b", False), ("v", "b", True), ("w", "a", True)], "variant string, scope string, ok boolean")
    assert {r[0]: r[1] for r in evaluation.balanced_accuracy(df, ("a", "b"), "variant").collect()} == {"v": 0.75, "w": None}


def test_event_metrics(spark):
    schema = "seq int, type string, rule_id string, marker string, node_path string, node_type string, debug_expression string, matched boolean, proposals_count int, generated_count int, fallback_count int, static_count int, candidate_kind string, candidate_id string, candidate_label string"
    none = [None] * 3
    log = [
        (0, "RuleEvaluationStarted", "r", *none, None, None, 0, 0, 0, 0, *none),
        (1, "GuardConditionEvaluated", "r", "prefix_all", "guard", "Term", "x", True, 0, 0, 0, 0, *none),
        (2, "ProposalsGenerated", "r", *none, None, None, 2, 1, 1, 0, *none),
        (3, "ProposalAccepted", "r", *none, None, None, 0, 0, 0, 0, "fallback", "c42", "L"),
    ]
    df = spark.createDataFrame(log, schema)
    r = telemetry.rule_metrics(df).first()
    assert (r.evaluations, r.firings, r.applied, r.proposals) == (1, 1, 1, 2)
    c = telemetry.condition_metrics(df).first()
    assert (c.section, c.operator, c.matched, c.seen) == ("prefix", "all", 1, 1)
    assert telemetry.candidate_choices(df).first().chosen == 1
    with pytest.raises(Exception, match="has no id"):
        telemetry.candidate_choices(df.withColumn("candidate_id", F.lit(""))).collect()


def test_merged_names(spark):
    df = spark.createDataFrame([("Avoid: A", 3, 2, 5, 1), ("avoid a", 3, 2, 1, 1)], "rule_name string, cases int, fired_cases int, evaluations int, applied int")
    assert tuple(telemetry.merged_by_name(df).first()) == ("avoid a", 3, 3, 6, 2)
    odd = df.withColumn("cases", F.col("evaluations"))
    with pytest.raises(Exception, match="differ in cases"):
        telemetry.merged_by_name(odd).select("applied").collect()


def test_scoring(spark):
    from glosswright.operators import scoring

    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    version = docs.select(scoring.version(F.col("text"))).first()[0]
    columns = "doc_id long, rule_id string, start int, stop int, op string, payload string, base_version_id string, candidate_index int, candidate_kind string, candidate_id string"
    rows_ = [
        (1, "r", 0, 2, "replace", "x", version, 0, "generated", "g"), (1, "r", 0, 2, "replace", "xyz", version, 1, "fallback", "f"), (1, "r", 4, 9, "replace", "", version, 0, "fallback", "f"),
        (1, "r", 0, 2, "replace", "x", "old", 0, "static", "s"), (1, "r", 3, 2, "replace", "x", version, 0, "static", "s"), (1, "r", 0, 2, "noop", "", version, 0, "static", "s"),
    ]
    left = scoring.editable(spark.createDataFrame(rows_, columns), docs)
    assert sorted((r.start, r.stop, r.skip_reason) for r in left.collect()) == [(0, 2, None), (0, 2, None), (4, 6, "invalid_span_clamped")]
    scored = scoring.two_phase(left, 1.05, scoring.length_scorer(docs))
    assert sorted((r.start, r.candidate_id, r.phase, r.winner, r.score) for r in scored.collect()) == [(0, "g", 0, True, -5.0), (4, "f", 1, True, -4.0)]
    assert [(r.start, r.patch_number) for r in scoring.numbered(scored).orderBy("patch_number").collect()] == [(4, 0), (0, 1)]
    logs = spark.range(1).select(scoring.weighted(*(F.array(*map(F.lit, x)) for x in ([-8.0, -1.0, -1.0, -2.0], [-3.0], [-1.0, -1.0, -2.0, -9.0])))).first()[0]
    assert logs == -1.0 - 3.0 - 2.0


def test_avoid_known_answer(spark):
    from glosswright.operators import avoid

    probes = spark.createDataFrame([("a", "p", i) for i in (1, 2)] + [("b", "p", 1)], "cache_key string, text string, rank int")
    asked = [(1, "r", "a", s, i) for i, s in enumerate((1, 1, 2, 3, 3, 4))] + [(1, "r", "b", 1, 9)] + [(1, "r", "c", 1, 10)]
    got = avoid.pops(spark.createDataFrame(asked, "case_id int, rule_id string, cache_key string, step int, seq int"), probes)
    assert [(r.outcome, r.candidate_id, r.exhausts) for r in got.orderBy("seq").collect()] == [
        ("popped", "probe_1", False), ("denied", None, False), ("popped", "probe_2", False), ("empty", None, True), ("empty", None, False), ("empty", None, False),
        ("popped", "probe_1", False), ("empty", None, True),
    ]
    assert sorted((r.cache_key, r.popped, r.exhausted) for r in avoid.episodes(got).collect()) == [("a", 2, True), ("b", 1, False), ("c", 0, True)]
    assert avoid.log(got).count() == 5
    kept = spark.createDataFrame([("go  on", "go on there"), ("go on", "stop"), ("", "x"), ("a", " ")], "prefix string, text string")
    assert [r.text for r in avoid.kept_probes(kept).collect()] == ["stop", "x"]
    floor = spark.range(1).select(avoid.floored_start(F.lit("One. Two."), F.lit(0), F.lit(9), F.lit(1)), avoid.floored_start(F.lit("One. Two."), F.lit(0), F.lit(9), F.lit(0))).first()
    assert floor[1] == 0 and floor[0] >= 0


def test_public_seams(spark):
    import glosswright
    from glosswright.operators import telemetry as t

    docs = spark.createDataFrame([(1, "We met with them of the house."), (2, "")], "doc_id long, text string")
    logs = []
    out = glosswright.run_step(docs, "## Replace: with\nWith:\n- beside\n", sink=logs.append)
    assert {r.doc_id: r.new_text for r in out.collect()}[1] == "We met beside them of the house."
    m = t.rule_metrics(logs[0]).first()
    assert (m.evaluations, m.firings, m.proposals, m.static, m.applied) == (2, 1, 1, 1, 1)
    none = glosswright.run_step(docs, "## Replace: with\nWith:\n- beside\n", candidates=lambda r: ())
    assert none.filter("new_text <> text").count() == 0


def test_condition_candidate_rows(spark):
    df = spark.createDataFrame([("r", ["a", "b"], []), ("s", [], ["x"])], "rule_id string, conditions array<string>, candidate_choices array<string>")
    assert sorted(map(str, map(tuple, telemetry.condition_candidate_rows(df).collect()))) == ["('r', 'a', None)", "('r', 'b', None)", "('s', None, 'x')"]


def test_cases(spark, tmp_path):
    df = spark.createDataFrame([("1", "orl", "q1", "g1"), ("2", "cardio", "q2", "g2"), ("3", "orl", "q3", "g3")], "id string, case_type string, question string, gold string")
    df.write.parquet(f"{tmp_path}/cases")
    got = cases.read_cases(spark, f"{tmp_path}/cases")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(cases.select_cases(got, n=2)) == ["1", "2"] and ids(cases.select_cases(got, n=1, case_type="orl")) == ["1"]
    assert ids(cases.select_cases(got, n=1, case_id="2")) == ["2"]
    with pytest.raises(ValueError, match="no case"):
        cases.lookup(got, "9")
    with pytest.raises(KeyError):
        cases.as_cases(df.drop("gold"))
    with pytest.raises(TypeError):
        cases.as_cases(df.withColumn("gold", F.lit(1)))
    subruns = spark.createDataFrame([("s1", "orl"), ("s2", None)], "subrun_id string, case_type string")
    assert cases.expand_subruns(subruns, got).count() == 5


def test_notebook(tmp_path):
    text = "# Rules\nRun: r1\nMode: editing\n- orl\n- cardio\n---\n## Replace: a\nWith:\n- b\n"
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["# Rules"]}, {"cell_type": "markdown", "source": text.splitlines(True)}]}))
    (found,) = cases.notebook_rulesets(str(tmp_path / "n.ipynb"))
    assert (found["run"], found["mode"], found["case_types"]) == ("r1", "editing", ["orl", "cardio"])
    assert len(compile_rules(found["rules"]).rules) == 1
    (tmp_path / "e.ipynb").write_text("{}")
    with pytest.raises(ValueError, match="no cell"):
        cases.notebook_rulesets(str(tmp_path / "e.ipynb"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "s1", 1, None), ("g", "s2", 2, "x")], "group_run_id string, subrun_id string, b int, a string")
    sinks.write_jsonl(df.coalesce(1), f"{tmp_path}/j")
    lines = [x for p in (tmp_path / "j").glob("part-*.json") for x in p.read_text().splitlines()]
    assert lines[0] == '{"a":null,"b":1,"group_run_id":"g","subrun_id":"s1"}'
    sinks.write_bundle(df, f"{tmp_path}/b")
    assert (tmp_path / "b/group_run_id=g/subrun_id=s2").is_dir()
    with pytest.raises(Exception, match="has no subrun_id"):
        sinks.write_bundle(df.withColumn("subrun_id", F.lit("")), f"{tmp_path}/c")


def test_replay(spark):
    texts = {1: "On les voit. Ils sont là pour toi et moi. les amis", 2: "", 3: "pour"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in replay.replay_documents(spark, docs, replay.RULES).collect()}
    assert set(got) == {1, 2, 3} and got[1].edits >= 2 and (got[2].text, got[2].ticks) == ("", 0)
    assert got[1].text.startswith("On ces voit.") and "tous" in got[1].text.lower()
    assert rows.step(compile_rules(replay.RULES), "les")[0] == "ces"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    # also without the optional subpackage
    assert set(sql) <= set(queries) and len(queries) >= 38


def test_queries_match_their_sql(spark):
    """A sample of the registered pairs on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "events"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("replace_first_anchor", "greedy_conflicts", "gold_grading", "scope_tail_sentences", "coverage_budget", "pairwise_transitions"):
        df = queries[name](spark, D)
        columns = sorted(df.columns)
        got = sorted(str([r[c] for c in columns]) for r in df.collect())
        rows_ = con.execute(f"select {', '.join(columns)} from ({sql[name]})").fetchall()
        assert got == sorted(str(list(r)) for r in rows_), name


def test_replay_query_takes_every_language(spark, tmp_path):
    from glosswright.queries import QUERIES

    rows = [(1, "pour les amis", "fr"), (2, "les one", "en"), (3, "les none", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["stream_token_replay"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[2] == "ces one" and got[3] == "ces none"


def test_scratch_tables_go(spark):
    import os

    from glosswright.sources.storage import materialize, scratch

    with scratch(spark) as outer:
        with scratch(spark) as inner:
            first, second, third = (materialize(spark.range(5), f"scratch-{i}") for i in range(3))
            inner.drop(first)
            assert not os.path.exists(first._scratch_path) and os.path.exists(second._scratch_path)
            inner.keep(third)
        assert not os.path.exists(second._scratch_path) and third.count() == 5
        with pytest.raises(ZeroDivisionError), scratch(spark):
            fourth = materialize(spark.range(5), "scratch-4")
            raise ZeroDivisionError
        assert not os.path.exists(fourth._scratch_path) and outer.paths == [third._scratch_path]
    assert not os.path.exists(third._scratch_path)


def test_words_end_where_the_sql_ends_them(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["éthe", "theé", "thé", "漢und", "bathe", "the9", "_und", "of theé", "é of the, OF THE_ xof the‍", None]
    turns = [(i, turn, role, text) for i, t in enumerate(texts) for turn, role, text in ((0, "user", "Onë"), (1, "assistant", t))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = duckdb.connect()
    for name, table in (("prompt_boundary_guard", "conversations"), ("match_spans_exploded", "documents")):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = sorted(tuple(r) for r in queries[name](spark, str(tmp_path)).collect())
        assert got and got == sorted(con.execute(sql[name]).fetchall())


def test_replay_leaves_out_idle_steps_only():
    """The replay gives what a step at every token gives, also when a text comes in two batches."""
    import hashlib
    import random

    def every_step(plan, pieces):
        text, ticks, edits, tried = "", 0, 0, set()
        for piece in pieces:
            text, ticks = text + piece, ticks + (piece != "")
            after, kept, _ = rows.step(plan, text, tick=ticks)
            marks = {hashlib.sha256(f"{e.start}:{e.stop}:{len(e.payload)}:{e.payload}{text[: e.start]}".encode()).hexdigest() for e in kept}
            if kept and not marks <= tried:
                tried, text, edits = tried | marks, after, edits + len(kept)
        return text, ticks, edits, tried

    rules = (
        replay.RULES, "## Replace (word): les|pour\nWith:\n- ces\n- pour les\n\n## After: pour\nScope:\n- 2 sentences\nAdd:\n- tous\n- les\n",
        "## Replace: a\nWith:\n- b\n## After: b\nScope:\n- 1 sentence\nAdd:\n- a.\n", "## Force: n\nAdd:\n- tous.\n",
    )
    rng = random.Random(5)
    words = ["les", "Les", "pour", "(pour", "pour,", "pour)", ".", "!", "tous", "ces", " ", "\n", "a", "b", "ß", "le", "s", "ſ", "pou", "r", "", ") "]
    for plan in map(compile_rules, rules):
        advance = rows.Replayer(plan)
        for _ in range(200):
            pieces = [rng.choice((" ", "")) + rng.choice(words) for _ in range(rng.randrange(1, 40))]
            cut = rng.randrange(len(pieces) + 1)
            want, half = every_step(plan, pieces), advance("", pieces[:cut], 0, 0, set())
            assert advance("", pieces, 0, 0, set()) == advance(half[0], pieces[cut:], *half[1:]) == want, pieces


def test_replay_of_long_texts(spark, monkeypatch):
    import time

    steps = []
    plain = rows.step
    monkeypatch.setattr(rows, "step", lambda *a, **k: steps.append(1) or plain(*a, **k))
    pieces = [f" w{i}" + "." * (i % 9 == 0) for i in range(20_000)] + [" les", " pour", " fin"]
    begin = time.time()
    text, ticks, edits, _ = rows.Replayer(compile_rules(replay.RULES))("", pieces, 0, 0, set())
    assert (ticks, edits, len(steps)) == (20_003, 2, 2) and text.endswith(" ces pour. Tous fin") and time.time() - begin < 10


def test_replay_of_several_blocks(spark):
    words = [f"w{i}" for i in range(3 * replay.BLOCK + 5)]
    words[replay.BLOCK - 1] = words[2 * replay.BLOCK] = "les"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in replay.replay_documents(spark, docs, replay.RULES).collect()}
    words[replay.BLOCK - 1] = "ces"
    assert (got[1].text, got[1].ticks, got[1].edits) == (" ".join(words), len(words), 1) and (got[2].text, got[2].ticks) == ("x", 1)
