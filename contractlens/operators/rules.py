"""The rule language, in two forms.

A tree is ``{all: [...]}``, ``{any: [...]}`` or a map of field to condition, all of which hold; a
condition is a literal or a map of operators.  Silence is null: every comparison with it is false,
and ``absent`` asks for it.

Over columns (:func:`evaluate`, :func:`by_type`) a tree compiles to one boolean column, which is what
many rows are judged by; :func:`by_type` keeps what a rule says besides in one constant.  A rulebook
is data too (:func:`judge`): each tree is a postfix programme, all programmes are one constant, and one
fold over a programme with a stack of booleans judges a map of field to value.  That plan is the same
for any number of rules and fields, but each row goes through the fold of each rule.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.functions.text import bound
from contractlens.operators import rulebook

RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}
BASES = ("statutory", "regulatory", "policy", "norm")
OPERATORS: dict[str, Callable[[Column, float], Column]] = {
    "gt": lambda c, x: c > F.lit(x),
    "gte": lambda c, x: c >= F.lit(x),
    "lt": lambda c, x: c < F.lit(x),
    "lte": lambda c, x: c <= F.lit(x),
}
Resolver = Callable[[str], Column]


class RuleError(ValueError):
    """A rule that can't be loaded or compiled."""


def fields_of(tree: dict) -> list[str]:
    """Every field that a condition tree names, both kinds of blocks walked."""
    out: list[str] = []
    for key, value in (tree or {}).items():
        if key in ("all", "any"):
            for part in value:
                out += fields_of(part)
        else:
            out.append(key)
    return list(dict.fromkeys(out))


def validate(rules: Iterable[dict]) -> list[dict]:
    """The rules, if ids are unique, bases known, sources or metrics there and no rule reads document facts alone."""
    seen: set[str] = set()
    rules = list(rules)
    for r in rules:
        if r["id"] in seen:
            raise RuleError(f"rule {r['id']} is there twice")
        seen.add(r["id"])
        if r.get("basis") not in BASES:
            raise RuleError(f"rule {r['id']} has an unknown basis")
        if r["basis"] == "norm" and not r.get("metric"):
            raise RuleError(f"rule {r['id']} rests on a norm and names no metric")
        if r["basis"] != "norm" and not r.get("source"):
            raise RuleError(f"rule {r['id']} names no source")
        names = fields_of(r["when"])
        if names and all(n.startswith("doc__") for n in names):
            raise RuleError(f"rule {r['id']} reads document facts alone")
    return rules


def _leaf(field: str, condition, resolve: Resolver, metric: str | None, norms: dict) -> Column:
    value = resolve(field)
    if not isinstance(condition, dict):
        return F.coalesce(value == F.lit(condition), F.lit(False))
    if "absent" in condition:
        return value.isNull() if condition["absent"] else value.isNotNull()
    parts = []
    for op, x in condition.items():
        if op == "gt_percentile":
            limit = (norms.get(metric or field) or {}).get(f"p{x}")
            parts.append(F.lit(False) if limit is None else value > F.lit(float(limit)))
        elif op in OPERATORS:
            parts.append(OPERATORS[op](value, x))
        else:
            raise RuleError(f"unknown operator {op}")
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def compile_tree(tree: dict, resolve: Resolver, metric: str | None = None, norms: dict | None = None) -> Column:
    """A condition tree as a boolean column that is never null."""
    norms = norms or {}
    if "all" in tree:  # beside it, any is not looked at
        return reduce(Column.__and__, (compile_tree(t, resolve, metric, norms) for t in tree["all"]), F.lit(True))
    if "any" in tree:
        return reduce(Column.__or__, (compile_tree(t, resolve, metric, norms) for t in tree["any"]), F.lit(False))
    return reduce(Column.__and__, (_leaf(f, c, resolve, metric, norms) for f, c in tree.items()), F.lit(True))


def severity(rule: dict, resolve: Resolver, norms: dict | None = None) -> Column:
    """Escalation goes to high; a norm that is not escalated goes to medium at most."""
    base = rule["severity"]
    plain = "medium" if rule["basis"] == "norm" and base == "high" else base
    if not rule.get("escalate_to_high_when"):
        return F.lit(plain)
    return F.when(compile_tree(rule["escalate_to_high_when"], resolve, rule.get("metric"), norms), F.lit("high")).otherwise(F.lit(plain))


def finding(rule: dict, order: int, resolve: Resolver, norms: dict | None = None) -> Column:
    """The struct of a rule that fires; it sorts by severity, high first, then by the rules' order."""
    level = severity(rule, resolve, norms)
    source = rule.get("source") or {}
    rank = reduce(lambda c, kv: c.when(level == kv[0], F.lit(-kv[1])), list(RANK.items())[1:], F.when(level == "none", F.lit(0)))
    text = lambda x: F.lit(x).cast("string")
    return F.struct(
        rank.alias("sort_rank"),
        F.lit(order).alias("rule_order"),
        F.lit(rule["id"]).alias("rule_id"),
        F.lit(rule["category"]).alias("category"),
        F.lit(rule["basis"]).alias("basis"),
        level.alias("severity"),
        F.lit(bool(rule.get("risky", rule["severity"] != "none"))).alias("risky"),
        F.lit(rule.get("scope", "clause")).alias("scope"),
        text(rule.get("metric")).alias("metric"),
        F.struct(*(text(source.get(k)).alias(k) for k in ("act", "section", "corpus_id", "provision", "query"))).alias("source"),
        F.array(*map(F.lit, rule.get("anchors") or [])).cast("array<string>").alias("anchors"),
        F.array(*map(F.lit, required_fields(rule))).alias("fields"),
        F.lit(rule["message"]).alias("message"),
    )


def required_fields(rule: dict) -> list[str]:
    """Fields of the condition and of the escalation."""
    return list(dict.fromkeys(fields_of(rule["when"]) + fields_of(rule.get("escalate_to_high_when") or {})))


def required_params(rules: Iterable[dict]) -> list[str]:
    """All fields that some rule reads, sorted."""
    return sorted({f for r in rules for f in required_fields(r)})


def findings(rules: list[dict], resolve: Resolver, norms: dict | None = None) -> Column:
    """The findings of one row as a sorted array."""
    fired = [F.when(compile_tree(r["when"], resolve, r.get("metric"), norms), finding(r, i, resolve, norms)) for i, r in enumerate(rules)]
    return F.array_sort(F.array_compact(F.array(*fired)))


def evaluate(df: DataFrame, rules: list[dict], resolve: Resolver | None = None, norms: dict | None = None) -> DataFrame:
    """df with ``findings``; by default fields are columns of df."""
    return df.withColumn("findings", findings(validate(rules), resolve or F.col, norms))


#: A step of a programme.  ``all`` and ``any`` fold the last n of the stack; the other steps put on it whether they hold for a field.
STEPS = "array<struct<op:string,field:string,x:double,s:string,n:int>>"
_SOURCE = ("act", "section", "corpus_id", "provision", "query")
RULE = (
    "struct<rule_order:int,rule_id:string,category:string,basis:string,severity:string,risky:boolean,scope:string,metric:string,"
    f"source:struct<{','.join(f'{k}:string' for k in _SOURCE)}>,anchors:array<string>,fields:array<string>,message:string,when:{STEPS},escalate:{STEPS}>"
)


def _step(op: str, field: str | None = None, x: float | None = None, s: str | None = None, n: int | None = None) -> dict:
    return {"op": op, "field": field, "x": None if x is None else float(x), "s": s, "n": n}


def _leaf_steps(field: str, condition, metric: str | None, norms: dict) -> list[dict]:
    if isinstance(condition, bool):
        return [_step("is", field, s=str(condition).lower())]
    if isinstance(condition, str):
        return [_step("is", field, s=condition)]
    if not isinstance(condition, dict):
        return [_step("eq", field, condition)]
    if "absent" in condition:
        return [_step("absent" if condition["absent"] else "present", field)]
    out = []
    for op, x in condition.items():
        if op == "gt_percentile":
            limit = (norms.get(metric or field) or {}).get(f"p{x}")
            out.append(_step("any", n=0) if limit is None else _step("gt", field, limit))
        elif op in OPERATORS:
            out.append(_step(op, field, x))
        else:
            raise RuleError(f"unknown operator {op}")
    return out if len(out) == 1 else [*out, _step("all", n=len(out))]


def programme(tree: dict, metric: str | None = None, norms: dict | None = None) -> list[dict]:
    """A condition tree as postfix steps."""
    norms = norms or {}
    if "all" in tree or "any" in tree:
        op = "all" if "all" in tree else "any"  # beside all, any is not looked at
        parts = [programme(t, metric, norms) for t in tree[op]]
    else:
        op, parts = "all", [_leaf_steps(f, c, metric, norms) for f, c in tree.items()]
    return parts[0] if len(parts) == 1 else [*(s for p in parts for s in p), _step(op, n=len(parts))]


def records(own: list[dict], norms: dict | None = None) -> list[dict]:
    """Rules as rows of RULE, in their order; ``severity`` is what an unescalated finding gets."""
    out = []
    for i, r in enumerate(validate(own)):
        source = r.get("source") or {}
        out.append({
            "rule_order": i, "rule_id": r["id"], "category": r["category"], "basis": r["basis"], "severity": "medium" if r["basis"] == "norm" and r["severity"] == "high" else r["severity"],
            "risky": bool(r.get("risky", r["severity"] != "none")), "scope": r.get("scope", "clause"), "metric": r.get("metric"), "source": {k: source.get(k) for k in _SOURCE}, "anchors": r.get("anchors") or [],
            "fields": required_fields(r), "message": r["message"], "when": programme(r["when"], r.get("metric"), norms), "escalate": programme(r["escalate_to_high_when"], r.get("metric"), norms) if r.get("escalate_to_high_when") else None,
        })
    return out


def programmes(rulebook_: dict[str, list[dict]], norms: dict | None = None) -> Column:
    """All rules of a rulebook as one constant: a map of type to array of RULE."""
    return F.from_json(F.lit(json.dumps({kind: records(own, norms) for kind, own in rulebook_.items()})), f"map<string,array<{RULE}>>")


FINDING = f"struct<sort_rank:int,rule_order:int,rule_id:string,category:string,basis:string,severity:string,risky:boolean,scope:string,metric:string,source:struct<{','.join(f'{k}:string' for k in _SOURCE)}>,anchors:array<string>,fields:array<string>,message:string>"


def by_type(kind: Column, rulebook_: dict[str, list[dict]], resolve: Resolver, norms: dict | None = None) -> Column:
    """The findings by the rules of a row's own type, as :func:`judge` gives them.

    A rule has one outcome, or one for each severity; outcomes stand in the order of findings, so
    those that apply are numbers that need no sorting, and what they say is looked up in a constant.
    """
    said: list[dict] = []
    numbers = F.when(F.lit(False), F.array().cast("array<int>"))
    for t, own in rulebook_.items():
        possible, known = [], records(own, norms)
        for r, record in zip(own, known, strict=True):
            when = compile_tree(r["when"], resolve, r.get("metric"), norms)
            if record["escalate"] is None or record["severity"] == "high":
                possible.append((-RANK[record["severity"]], when, record | {"sort_rank": -RANK[record["severity"]]}))
                continue
            more = compile_tree(r["escalate_to_high_when"], resolve, r.get("metric"), norms)
            for level, condition in (("high", when & more), (record["severity"], when & ~more)):
                possible.append((-RANK[level], condition, record | {"severity": level, "sort_rank": -RANK[level]}))
        possible.sort(key=lambda x: (x[0], x[2]["rule_order"]))
        hits = [F.when(condition, F.lit(len(said) + i)) for i, (_, condition, _) in enumerate(possible)]
        said += [{k: v for k, v in record.items() if k not in ("when", "escalate")} for _, _, record in possible]
        numbers = numbers.when(kind == t, F.array_compact(F.array(*hits).cast("array<int>")))
    constant = F.from_json(F.lit(json.dumps(said)), f"array<{FINDING}>")
    return F.transform(F.coalesce(numbers, F.array().cast("array<int>")), lambda i: F.get(constant, i))


def in_map(values: Column) -> Resolver:
    """Fields of a map of field to text by their kinds; what is not of its kind is silence."""

    def resolve(field: str) -> Column:
        text, kind = F.try_element_at(values, F.lit(field)), rulebook.KINDS.get(field, "boolean")
        return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False)) if kind == "boolean" else text.try_cast(kind)

    return resolve


def rules_table(spark: SparkSession, rulebook_: dict[str, list[dict]], norms: dict | None = None) -> DataFrame:
    """doc_type and the columns of RULE, a row for each rule."""
    one = spark.range(1).select(F.explode(programmes(rulebook_, norms)).alias("doc_type", "own"))
    return one.select("doc_type", F.explode("own").alias("r")).select("doc_type", "r.*")


def values_of(params: Column) -> Column:
    """A struct of fields as a map of field to text, without those that are null."""
    return F.from_json(F.to_json(params), "map<string,string>")


def holds(steps: Column, values: Column) -> Column:
    """Whether a programme holds for a map of field to text."""

    def leaf(s: Column) -> Column:
        text = F.try_element_at(values, s["field"])
        op, x, number = s["op"], s["x"], text.try_cast("double")
        compared = F.when(op == "is", text == s["s"]).when(op == "eq", number == x).when(op == "gt", number > x).when(op == "gte", number >= x).when(op == "lt", number < x).when(op == "lte", number <= x)
        return F.when(op == "absent", text.isNull()).when(op == "present", text.isNotNull()).otherwise(F.coalesce(compared, F.lit(False)))

    def step(stack: Column, s: Column) -> Column:
        last = F.slice(stack, F.size(stack) - s["n"] + 1, s["n"])
        folded = F.when(s["op"] == "all", ~F.array_contains(last, False)).otherwise(F.array_contains(last, True))
        return F.when(s["op"].isin("all", "any"), F.array_append(F.slice(stack, F.lit(1), F.size(stack) - s["n"]), folded)).otherwise(F.array_append(stack, leaf(s)))

    return F.get(F.aggregate(steps, F.array().cast("array<boolean>"), step), F.lit(0))


def judge(values: Column, own: Column) -> Column:
    """The findings of an array of RULE on a map of field to text, sorted as :func:`findings` sorts them."""

    def found(r: Column) -> Column:
        level = F.when(F.coalesce(holds(r["escalate"], values), F.lit(False)), F.lit("high")).otherwise(r["severity"])
        rank = -F.array_position(F.array(*map(F.lit, list(RANK)[1:])), level)  # 0 for none
        return F.struct(rank.cast("int").alias("sort_rank"), *(r[k].alias(k) for k in ("rule_order", "rule_id", "category", "basis")), level.alias("severity"), *(r[k].alias(k) for k in ("risky", "scope", "metric", "source", "anchors", "fields", "message")))

    fired = F.transform(F.filter(own, lambda r: holds(r["when"], values)), found)
    return F.coalesce(F.array_sort(fired), F.slice(fired, F.lit(1), F.lit(0)))


def params_columns(json: Column, fields: Iterable[str]) -> dict[str, Column]:
    """Typed fields of supplied or extracted parameters in JSON; a wrong type is silence."""
    v = F.try_parse_json(json)
    return {f: F.try_variant_get(v, f"$.{f}", rulebook.KINDS.get(f, "boolean")) for f in fields}


def typed_params(json: Column, fields: Iterable[str]) -> Column:
    """The fields of :func:`params_columns` as a struct, the JSON read once for all of them."""
    fields = list(fields)
    return bound(F.try_parse_json(json), lambda v: F.struct(*(F.try_variant_get(v, f"$.{f}", rulebook.KINDS.get(f, "boolean")).alias(f) for f in fields)))


def lint(rules: dict[str, list[dict]], gates: Iterable[str], taxonomy: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(type, rule, kind) for what a rule file has that looks wrong but loads."""
    out = []
    gates = set(gates)
    for kind, own in rules.items():
        for r in own:
            if r["severity"] == "high" and r["basis"] == "norm" and not r.get("escalate_to_high_when"):
                out.append((kind, r["id"], "severity"))
            if any(f.startswith("doc__") for f in required_fields(r)) and r.get("scope") != "document" and all(f.startswith("doc__") or f not in gates for f in required_fields(r)):
                out.append((kind, r["id"], "scope"))
            if r["category"] not in taxonomy.get(kind, []):
                out.append((kind, r["id"], "subject"))
            if any(f not in gates and not f.startswith("doc__") and f not in rulebook.READER_ONLY for f in required_fields(r)):
                out.append((kind, r["id"], "gates"))
            if r["basis"] != "norm" and not r.get("anchors"):
                out.append((kind, r["id"], "citations"))
    return out
