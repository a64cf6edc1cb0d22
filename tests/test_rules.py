import pytest
from pyspark.sql import functions as F

from contractlens.operators import gates, rulebook, rules


def fired(spark, rows, schema, ruleset, norms=None):
    df = rules.evaluate(spark.createDataFrame(rows, schema), ruleset, norms=norms)
    return [[(f["rule_id"], f["severity"]) for f in r["findings"]] for r in df.select("findings").collect()]


def rule(**k):
    return {"id": "R", "category": "c", "basis": "statutory", "severity": "low", "source": {"act": "a"}, "message": "m"} | k


def test_silence_matches_nothing_but_absent(spark):
    own = [rule(id="A", when={"x": {"absent": True}}), rule(id="B", when={"x": {"gt": 1}}), rule(id="C", when={"x": False}), rule(id="D", when={"x": {"absent": False}})]
    own[2]["when"] = {"b": False}
    assert fired(spark, [(None, None), (2.0, False), (1.0, True)], "x double, b boolean", own) == [[("A", "low")], [("B", "low"), ("C", "low"), ("D", "low")], [("D", "low")]]


def test_blocks(spark):
    own = [rule(id="all", when={"all": [{"b": True}, {"x": {"lte": 3}}]}), rule(id="any", when={"any": [{"b": True}, {"x": {"lt": 0}}]}), rule(id="empty", when={"any": []}), rule(id="both", when={"all": [{"b": True}], "any": [{"x": {"lt": -100}}]})]
    assert fired(spark, [(3.0, True), (-1.0, False)], "x double, b boolean", own) == [[("all", "low"), ("any", "low"), ("both", "low")], [("any", "low")]]


def test_severity_order_escalation_and_cap(spark):
    own = [rule(id="low", when={"b": True}), rule(id="up", severity="medium", when={"b": True}, escalate_to_high_when={"x": {"gt": 5}}), rule(id="norm", basis="norm", metric="x", severity="high", when={"b": True})]
    assert fired(spark, [(6.0, True), (1.0, True)], "x double, b boolean", own) == [[("up", "high"), ("norm", "medium"), ("low", "low")], [("up", "medium"), ("norm", "medium"), ("low", "low")]]


def test_percentile_needs_norms(spark):
    own = [rule(basis="norm", metric="x", when={"x": {"gt_percentile": 90}})]
    assert fired(spark, [(6.0,)], "x double", own) == [[]]
    assert fired(spark, [(6.0,)], "x double", own, {"x": {"p90": 5}}) == [[("R", "low")]]


@pytest.mark.parametrize(
    "bad",
    [[rule(when={"x": 1}), rule(when={"x": 1})], [rule(basis="odd", when={"x": 1})], [rule(source=None, when={"x": 1})], [rule(basis="norm", when={"x": 1})], [rule(when={"doc__x": 1}, scope="document")]],
)
def test_refused_at_load(bad):
    with pytest.raises(rules.RuleError):
        rules.validate(bad)


def test_unknown_operator():
    with pytest.raises(rules.RuleError):
        rules.compile_tree({"x": {"near": 1}}, lambda f: F.lit(1))


def test_census():
    assert [len(rulebook.RULES[t]) for t in ("employment", "rental", "loan")] == [19, 15, 14]
    assert [len(rules.required_params(rulebook.RULES[t])) for t in ("employment", "rental", "loan")] == [31, 21, 18]
    bases = [r["basis"] for own in rulebook.RULES.values() for r in own]
    assert {b: bases.count(b) for b in set(bases)} == {"statutory": 11, "regulatory": 4, "policy": 4, "norm": 29}
    for own in rulebook.RULES.values():
        rules.validate(own)


def test_lint_names_categories_outside_the_taxonomy():
    found = rules.lint(rulebook.RULES, gates.GATES, {t: p["taxonomy"] for t, p in rulebook.PROFILES.items()})
    assert {r for _, r, kind in found if kind == "subject"} == {"R-EMP-15", "R-EMP-16", "R-EMP-17", "R-EMP-18", "R-EMP-19"}


def test_lint_by_kind(spark):
    from contractlens.sources import readers

    rows = {r["kind"]: r for r in readers.lint_report(spark).collect()}
    found = rules.lint(rulebook.RULES, gates.GATES, {t: p["taxonomy"] for t, p in rulebook.PROFILES.items()})
    assert rows["subject"]["rules"] == [f"employment R-EMP-{n}" for n in (15, 16, 17, 18, 19)] and sum(r["n"] for r in rows.values()) == len(found)


def test_programmes_judge_as_columns_do(spark):
    """Both forms of a rulebook over the same parameters, with silence, escalation, percentiles and empty blocks."""
    own = [
        rule(id="all", when={"all": [{"b": True}, {"x": {"lte": 3, "gt": -5}}]}, escalate_to_high_when={"x": {"gt": 2}}), rule(id="any", when={"any": [{"b": False}, {"x": {"lt": 0}}, {"s": "word"}]}),
        rule(id="none", when={"any": []}), rule(id="every", when={"all": []}), rule(id="absent", severity="high", when={"all": [{"x": {"absent": True}}, {"b": {"absent": False}}]}), rule(id="equal", severity="none", when={"x": 2}),
        rule(id="norm", basis="norm", metric="m", severity="high", when={"x": {"gt_percentile": 90}}), rule(id="unknown", basis="norm", metric="n", when={"x": {"gt_percentile": 75}}), rule(id="deep", when={"all": [{"any": [{"b": True}, {"all": [{"x": {"gte": 0}}, {"s": {"absent": True}}]}]}, {"x": {"lt": 9}}]}),
    ]
    norms = {"m": {"p90": 1}}
    values = [(x, b, s) for x in (None, -9.0, -1.0, 0.0, 1.0, 2.0, 3.0, 10.0, float("nan")) for b in (None, True, False) for s in (None, "word", "true")]
    df = spark.createDataFrame(values, "x double, b boolean, s string")
    both = df.select(rules.findings(own, F.col, norms).alias("a"), rules.judge(rules.values_of(F.struct("x", "b", "s")), F.get(F.map_values(rules.programmes({"t": own}, norms)), F.lit(0))).alias("b"))
    for r in both.collect():
        assert [f.asDict(True) for f in r["a"]] == [f.asDict(True) for f in r["b"]]
    with pytest.raises(rules.RuleError):
        rules.programme({"x": {"near": 1}})


def test_stopped_fields(spark):
    texts = ["the deposit is held", "nothing of it", "sexual harassment at work: termination", "termination for any reason", None]
    fields = ["deposit_months", "cause_undefined_or_vague", "perpetual", "bond_present", "no_gate"]
    given = {"deposit_months": 2.0, "cause_undefined_or_vague": True, "perpetual": False, "bond_present": True, "no_gate": True}
    kinds = {"deposit_months": "double"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    values = {f: F.lit(given[f]) for f in fields}
    got = df.select(F.sort_array(gates.dropped(values, F.col("t"), kinds)).alias("a"), gates.stopped(rules.values_of(F.struct(*(v.alias(f) for f, v in values.items()))), F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[0]["b"] != got[1]["b"]


def test_rules_by_type_judge_as_programmes_do(spark):
    """Outcomes looked up by number give the findings of the fold, in its order, for each type and for none."""
    book = {
        "a": [rule(id="plain", when={"b": True}), rule(id="up", severity="low", when={"x": {"gt": 0}}, escalate_to_high_when={"x": {"gt": 2}}), rule(id="good", severity="none", when={"s": "word"}), rule(id="top", severity="high", when={"x": {"absent": True}})],
        "b": [rule(id="norm", basis="norm", metric="m", severity="high", when={"x": {"gt_percentile": 90}}, escalate_to_high_when={"b": False}), rule(id="any", when={"any": [{"b": False}, {"s": {"absent": True}}]})],
    }
    norms = {"m": {"p90": 1}}
    df = spark.createDataFrame([(t, x, b, s) for t in ("a", "b", "c", None) for x in (None, 0.0, 1.5, 3.0, float("nan")) for b in (None, True, False) for s in (None, "word", "true")], "t string, x double, b boolean, s string")
    own = F.coalesce(F.try_element_at(rules.programmes(book, norms), F.col("t")), F.array().cast(f"array<{rules.RULE}>"))
    both = df.select("t", rules.by_type(F.col("t"), book, F.col, norms).alias("a"), rules.judge(rules.values_of(F.struct("x", "b", "s")), own).alias("b")).collect()
    for r in both:
        assert [f.asDict(True) for f in r["a"]] == [f.asDict(True) for f in r["b"]]
    assert any(r["a"] for r in both) and not any(r["a"] for r in both if r["t"] in ("c", None))


def test_every_rule_is_dealt_out(spark):
    """The orders are one file of one row group: without being dealt out they are one task."""
    from contractlens.plans import queries

    for name in ("every_rule", "evaluate_clause"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_every_gate_by_shared_alternatives(spark):
    """Each field passes where its own patterns do, whatever the case of the letters and signs that match one; the plan writes no pattern out twice."""
    said = ["", *gates.WORDS, *(w.upper() + " x" for w in gates.WORDS), "Minimum\u00a0Period", "depo\u017fit", "boo\u212a of RENT", "the different loans", "Set-Off", "lock in", "\u0130nterest", "POSH termination", "Sexual Harassment: TERMINATED without assigning", "sum\nof", "re-fix the monthly payment", "license  fee, revised"]
    fields = sorted(gates.GATES)
    df = spark.createDataFrame([(t,) for t in [*said, None]], "t string")
    given = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array_repeat(F.lit("true"), len(fields)))
    both = df.select("t", gates.dropped({f: F.lit(True) for f in fields}, F.col("t"), {}).alias("a"), gates.stopped(given, F.col("t")).alias("b")).collect()
    for r in both:
        assert sorted(r["a"]) == r["b"], r["t"]
    held = df.select(gates.spoken(gates.lowered(F.col("t"))).alias("x"))
    assert all(held._jdf.queryExecution().optimizedPlan().toString().count(p) <= 2 for p in ("sum\\s+of", "work\\s+product"))
