"""The rule language: text to a tree, and the tree to columns that whole-stage code can run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.errors import RuleError
from dialoom.functions import text as T

# ---------------------------------------------------------------- the tree


@dataclass(frozen=True)
class Test:
    family: str
    operator: str
    field: str = "text"
    value: object = ""
    threshold: float | None = None
    cost: int = 1
    extra: tuple = ()


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Negation:
    part: object


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    tree: object
    tags: tuple[str, ...] = ()
    priority: int = 0
    metadata: dict = field(default_factory=dict, hash=False)


#: Costs by family, priorities by name, and comparison signs.
COST = {"lexical": 1, "structural": 2, "contextual": 3, "semantic": 4}
PRIORITY = {"low": 0, "medium": 5, "high": 10, "critical": 20}
SIGNS = {"==": "eq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "!=": "neq"}
FIELDS = {"speaker": "speaker_role", "channel": "channel"}

# ---------------------------------------------------------------- reading

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[^\W\d]\w*)|(?P<sign>==|!=|>=|<=|>|<)|(?P<mark>[().,\[\]=])"""
)
_WORDS = {"AND", "OR", "NOT", "RULE", "WHEN", "THEN"}


@dataclass(frozen=True)
class _Token:
    kind: str
    value: object
    at: int


def lex(source: str) -> list[_Token]:
    out, at = [], 0
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise RuleError(f"unexpected {source[at]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        if kind == "string":
            out.append(_Token(kind, re.sub(r"\\(.)", r"\1", raw[1:-1]), at))
        elif kind == "number":
            out.append(_Token(kind, float(raw) if "." in raw else int(raw), at))
        elif kind == "name" and raw.upper() in _WORDS:
            out.append(_Token("word", raw.upper(), at))
        elif kind != "space":
            out.append(_Token(kind, raw, at))
        at = m.end()
    return [*out, _Token("end", None, len(source))]


class _Reader:
    def __init__(self, source: str):
        self.tokens, self.k = lex(source), 0

    @property
    def next(self) -> _Token:
        return self.tokens[self.k]

    def take(self, kind: str, value: object = None) -> _Token | None:
        t = self.next
        if t.kind == kind and (value is None or t.value == value):
            self.k += 1
            return t
        return None

    def need(self, kind: str, value: object = None) -> _Token:
        if (t := self.take(kind, value)) is None:
            raise RuleError(f"expected {value or kind} at {self.next.at}, found {self.next.value!r}")
        return t

    def expression(self, level: int = 0):
        """level 0: OR, 1: AND, 2: NOT or an atom."""
        if level == 2:
            return Negation(self.expression(2)) if self.take("word", "NOT") else self.atom()
        parts = [self.expression(level + 1)]
        while self.take("word", ("OR", "AND")[level]):
            parts.append(self.expression(level + 1))
        return parts[0] if len(parts) == 1 else (Any, All)[level](tuple(parts))

    def atom(self):
        if self.take("mark", "("):
            inner = self.expression()
            self.need("mark", ")")
            return inner
        name = self.need("name")
        if self.take("mark", "."):
            calls = [self.call()]
            while self.take("mark", "."):
                calls.append(self.call())
            sign = self.take("sign")
            return _dotted(name.value, calls, sign and (SIGNS[sign.value], self.value()), name.at)
        if sign := self.take("sign"):
            return _infix(name, SIGNS[sign.value], self.value())
        return _plain(name.value, self.arguments()[0], name.at)

    def call(self) -> tuple[str, list, dict]:
        name = self.need("name").value
        return name, *self.arguments()

    def value(self):
        for kind in ("string", "number", "name"):
            if t := self.take(kind):
                return t.value
        raise RuleError(f"expected a value at {self.next.at}")

    def arguments(self) -> tuple[list, dict]:
        self.need("mark", "(")
        values, named = [], {}
        while not self.take("mark", ")"):
            if values or named:
                self.need("mark", ",")
            if self.take("mark", "["):
                items = []
                while not self.take("mark", "]"):
                    if items:
                        self.need("mark", ",")
                    items.append(self.value())
                values.append(items)
                continue
            at = self.next
            got = self.value()
            if at.kind == "name" and self.take("mark", "="):
                named[got] = self.value()
            else:
                values.append(got)
        return values, named


# ---------------------------------------------------------------- predicates


def _listed(args: list) -> list[str]:
    return [str(x) for a in args for x in (a if isinstance(a, list) else [a])]


def _count(name: str, args: list, low: int, high: int, at: int) -> None:
    if not low <= len(args) <= high:
        raise RuleError(f"{name} takes {low} to {high} arguments, not {len(args)}, at {at}")


_TEXT_TESTS = {"keyword": "contains", "word": "word", "stem": "stem", "regex": "regex", "not_contains": "not_contains", "starts_with": "starts_with", "ends_with": "ends_with"}


def _plain(name: str, args: list, at: int) -> Test:
    if name in _TEXT_TESTS:
        _count(name, args, 1, 2, at)
        of, value = args if len(args) == 2 else ("text", args[0])
        return Test("lexical", _TEXT_TESTS[name], str(of), str(value))
    if name in ("contains_any", "contains_all", "excludes_any"):
        _count(name, args, 1, 1 << 10, at)
        return Test("lexical", name, value=tuple(_listed(args)))
    if name == "near":
        _count(name, args, 3, 3, at)
        return Test("lexical", "near", value=str(args[0]), extra=(str(args[1]), int(args[2])))
    if name in FIELDS:
        _count(name, args, 1, 1, at)
        return Test("structural", "eq", FIELDS[name], str(args[0]), cost=2)
    if name in ("field_eq", "field_gte", "field_lte"):
        _count(name, args, 2, 2, at)
        return Test("structural", name.removeprefix("field_"), str(args[0]), args[1], cost=2)
    if name == "intent":
        _count(name, args, 1, 2, at)
        return Test("semantic", "gte", "intent_score", str(args[0]), float(args[1]) if len(args) > 1 else None, 4)
    if name == "similarity":
        _count(name, args, 3, 3, at)
        return Test("semantic", "similarity_above", str(args[0]), str(args[1]), float(args[2]), 4)
    if name == "repeated":
        _count(name, args, 3, 3, at)
        return Test("contextual", "repeated", str(args[0]), str(args[1]), cost=3, extra=(int(args[2]),))
    if name == "occurs_after":
        _count(name, args, 3, 3, at)
        return Test("contextual", "occurs_after", str(args[0]), str(args[1]), cost=3, extra=(str(args[2]),))
    raise RuleError(f"unknown predicate {name} at {at}")


def _dotted(space: str, calls: list, compare: tuple | None, at: int) -> Test:
    name, args, named = calls[0]
    if space == "context":
        if name != "turn_window":
            raise RuleError(f"unknown predicate context.{name} at {at}")
        method, _, conditions = calls[1] if len(calls) > 1 else ("any", [], {})
        return Test("contextual", f"window_{method}", "text", int(args[0]) if args else 0, float(compare[1]) if compare else None, 3, (tuple(sorted(conditions.items())), compare[0] if compare else "gte"))
    if space == "lexical":
        known = _TEXT_TESTS | {"contains": "contains"}
        if name in known and name != "keyword":
            return Test("lexical", known[name], value=str(args[0]) if args else "")
        if name in ("contains_any", "contains_all", "excludes_any"):
            return Test("lexical", name, value=tuple(_listed(args)))
        if name == "near":
            a, b = (str(args[i]) if len(args) > i else "" for i in (0, 1))
            return Test("lexical", "near", value=a, extra=(b, int(args[2]) if len(args) > 2 else 3))
    if space == "semantic" and name in ("intent", "similarity"):
        sign, limit = compare or ("gte" if name == "intent" else "similarity_above", None)
        return Test("semantic", sign, "intent_score" if name == "intent" else "embedding_similarity", str(args[0]) if args else "", None if limit is None else float(limit), 4)
    raise RuleError(f"unknown predicate {space}.{name} at {at}")


def _infix(name: _Token, sign: str, value) -> Test:
    if name.value not in FIELDS:
        raise RuleError(f"unknown field {name.value} at {name.at}")
    return Test("structural", sign, FIELDS[name.value], value, cost=2)


# ---------------------------------------------------------------- rules


def parse(source: str) -> object:
    reader = _Reader(source)
    tree = reader.expression()
    reader.need("end")
    return tree


def tests_of(tree) -> Iterator[Test]:
    if isinstance(tree, Test):
        yield tree
    for p in getattr(tree, "parts", ()) or ([tree.part] if isinstance(tree, Negation) else []):
        yield from tests_of(p)


def _depth(tree) -> int:
    inner = getattr(tree, "parts", ()) or ([tree.part] if isinstance(tree, Negation) else [])
    return 1 + max(map(_depth, inner), default=0)


def compile_rule(source: str, rule_id: str, name: str | None = None) -> Rule:
    """A rule from an expression, or from a block RULE name WHEN expression THEN actions."""
    if not source.strip():
        raise RuleError("empty rule")
    tags, priority, meta = (), 0, {}
    if source.strip().startswith("RULE "):
        reader = _Reader(source)
        reader.need("word", "RULE")
        name = reader.need("name").value
        reader.need("word", "WHEN")
        tree = reader.expression()
        reader.need("word", "THEN")
        while not reader.take("end"):
            at = reader.next.at
            action, args, _ = reader.call()
            if action == "tag" and args:
                tags += (str(args[0]),)
            elif action == "score" and args:
                meta["score_override"] = args[0]
            elif action == "priority" and args:
                priority = PRIORITY.get(str(args[0]).lower(), 10)
            else:
                raise RuleError(f"unknown action {action} at {at}")
    else:
        tree = parse(source)
    if _depth(tree) > 20:
        raise RuleError("a rule is at most 20 levels deep")
    for t in tests_of(tree):
        if t.threshold is not None and t.family == "semantic" and not 0 <= t.threshold <= 1:
            raise RuleError(f"a threshold is between 0 and 1, not {t.threshold}")
        if t.operator == "regex":
            try:
                re.compile(str(t.value))
            except re.error as e:
                raise RuleError(f"{t.value!r} is no pattern: {e}") from e
    return Rule(rule_id, name or rule_id, tree, tags, priority, meta)


def to_dsl(tree) -> str:
    """A tree as rule text."""
    if isinstance(tree, Negation):
        return f"NOT {to_dsl(tree.part)}"
    if isinstance(tree, (All, Any)):
        return "(" + (" AND " if isinstance(tree, All) else " OR ").join(map(to_dsl, tree.parts)) + ")"
    names, signs = {v: k for k, v in _TEXT_TESTS.items()}, {v: k for k, v in SIGNS.items()}
    if tree.operator in names and tree.family == "lexical":
        return f"{names[tree.operator]}({_quoted(tree.field)}, {_quoted(tree.value)})"
    if isinstance(tree.value, tuple):
        return f"{tree.operator}([{', '.join(map(_quoted, tree.value))}])"
    if tree.operator == "near":
        return f"near({_quoted(tree.value)}, {', '.join(map(_quoted, tree.extra))})"
    if tree.family == "contextual" and tree.operator.startswith("window_"):
        conditions, sign = tree.extra
        call = f"context.turn_window({tree.value}).{tree.operator.removeprefix('window_')}({', '.join(f'{k}={_quoted(v)}' for k, v in conditions)})"
        return call if tree.threshold is None else f"{call} {signs[sign]} {_quoted(tree.threshold)}"
    if tree.family == "contextual":
        return f"{tree.operator}({_quoted(tree.field)}, {_quoted(tree.value)}, {_quoted(tree.extra[0])})"
    if tree.family == "semantic":
        if tree.operator == "similarity_above" and tree.threshold is not None:
            return f"similarity({_quoted(tree.field)}, {_quoted(tree.value)}, {_quoted(tree.threshold)})"
        call = f"semantic.{'intent' if tree.field == 'intent_score' else 'similarity'}({_quoted(tree.value)})"
        return call if tree.threshold is None else f"{call} {signs[tree.operator]} {_quoted(tree.threshold)}"
    back = {v: k for k, v in FIELDS.items()}
    if tree.field in back:
        return f"{back[tree.field]} {signs[tree.operator]} {_quoted(tree.value)}"
    return f"field_{tree.operator}({_quoted(tree.field)}, {_quoted(tree.value)})"


def _quoted(value) -> str:
    """A value as the lexer reads it; it knows no exponents."""
    if isinstance(value, float):
        return format(Decimal(repr(value)), "f")
    return str(value) if isinstance(value, int) else '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


# ---------------------------------------------------------------- columns

EVIDENCE = "struct<family: string, field: string, operator: string, matched: boolean, score: double, threshold: double, matched_text: string>"


@dataclass
class Scope:
    """Where tests find their input. text is folded once, as a column of its own."""

    columns: set[str]
    folded: str = "_folded"
    tokens: str = "_tokens"
    turn_window: Callable[[Test], Column] | None = None  # gives context.turn_window a meaning; without it, it never matches

    def field(self, name: str) -> Column:
        if name in ("text", "speaker_role", "source_type", "source_id") and name in self.columns:
            return F.col(name).cast("string")
        found = [F.element_at(m, F.lit(name)).cast("string") for m in ("features", "metadata") if m in self.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def text(self, name: str) -> Column:
        return F.col(self.folded) if name == "text" else F.coalesce(T.fold(self.field(name)), F.lit(""))

    def words(self, name: str) -> Column:
        return F.col(self.tokens) if name == "text" else T.words(self.text(name))


def _test(t: Test, scope: Scope) -> tuple[Column, Column, Column]:
    """(matched, score, matched text) of a test."""
    none = F.lit(None).cast("string")
    flag = lambda m, text=None: (m, m.cast("double"), F.when(m, text if text is not None else none))
    op = t.operator
    if t.family == "lexical":
        body, words = scope.text(t.field), scope.words(t.field)
        want = T.fold_text(t.value) if isinstance(t.value, str) else ""
        if op == "contains":
            return flag(F.contains(body, F.lit(want)), F.lit(t.value))
        if op == "word":
            pattern = rf"(?U)\b\Q{want}\E\b"
            return flag(body.rlike(pattern), F.regexp_extract(body, pattern, 0))
        if op == "stem":
            found = F.filter(words, lambda w: w.startswith(want))
            return flag(F.size(found) > 0, F.array_join(found, ", "))
        if op == "regex":
            pattern = "(?iuU)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", str(t.value))
            return flag(body.rlike(pattern), F.regexp_extract(body, pattern, 0))
        if op == "not_contains":
            miss = ~F.contains(body, F.lit(want))
            return miss, miss.cast("double"), F.when(~miss, F.lit(t.value))
        if op == "starts_with":
            return flag(body.startswith(want), F.lit(t.value))
        if op == "ends_with":
            return flag(body.endswith(want), F.lit(t.value))
        if op in ("contains_any", "contains_all", "excludes_any"):
            each = F.array(*[F.when(F.contains(body, F.lit(T.fold_text(v))), F.lit(v)) for v in t.value]).cast("array<string>")
            found, n = F.filter(each, lambda x: x.isNotNull()), len(t.value)
            text = F.when(F.size(found) > 0, F.array_join(found, ", "))
            if op == "excludes_any":
                free = F.size(found) == 0
                return free, free.cast("double"), text
            return (F.size(found) > 0 if op == "contains_any" else F.size(found) == n), (F.size(found) / max(n, 1)).cast("double"), text
        if op == "near":
            other, most = t.extra
            at = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
            apart = F.array_min(F.flatten(F.transform(at(want), lambda i: F.transform(at(T.fold_text(other)), lambda j: F.abs(i - j)))))
            return flag(F.coalesce(apart <= most, F.lit(False)), F.concat(F.lit(f"{t.value} ~ {other} (dist="), apart.cast("string"), F.lit(")")))
    if t.family == "semantic":
        value = F.coalesce(scope.field(t.field).try_cast("double"), F.lit(0.0))
        limit = 0.5 if t.threshold is None else t.threshold
        tests = {"gte": value >= limit, "similarity_above": value >= limit, "gt": value > limit, "lt": value < limit, "lte": value <= limit}
        return tests.get(op, F.lit(False)), value, none
    if t.family == "structural":
        value = scope.field(t.field)
        if op in ("eq", "neq"):
            same = F.coalesce(F.lower(value) == str(t.value).lower(), F.lit(False))
            return flag(same if op == "eq" else ~same, value)
        try:
            number = float(t.value)
        except (TypeError, ValueError):
            return flag(F.lit(False))
        got = value.try_cast("double")
        return flag(F.coalesce({"gte": got >= number, "lte": got <= number, "gt": got > number, "lt": got < number}[op], F.lit(False)), value)
    body = scope.text("text")
    want = T.fold_text(str(t.value))
    if op == "repeated":
        least = t.extra[0]
        n = ((F.char_length(body) - F.char_length(F.replace(body, F.lit(want), F.lit("")))) / F.lit(max(1, len(want)))).cast("int") if want else F.lit(0)
        return n >= least, F.least(n / float(max(1, least)), F.lit(1.0)), F.when(n >= least, F.concat(F.lit(f"{t.value} (x"), n.cast("string"), F.lit(")")))
    if op == "occurs_after":
        a, b = F.instr(body, want), F.instr(body, T.fold_text(t.extra[0]))
        return flag((a > 0) & (b > a), F.lit(f"{t.value} → {t.extra[0]}"))
    if scope.turn_window is not None:
        return flag(scope.turn_window(t))
    return F.lit(False), F.lit(0.0), none


@dataclass
class _Out:
    matched: Column
    score: Column
    evidence: Column
    evaluated: Column


def _cost(tree) -> int:
    return max(t.cost for t in tests_of(tree))


def _compose(tree, leaf: Callable[[Test], _Out], by_cost: bool) -> _Out:
    if isinstance(tree, Test):
        return leaf(tree)
    if isinstance(tree, Negation):
        x = _compose(tree.part, leaf, by_cost)
        return _Out(~x.matched, 1 - x.score, x.evidence, x.evaluated)
    parts = sorted(tree.parts, key=_cost) if by_cost else list(tree.parts)
    outs = [_compose(p, leaf, by_cost) for p in parts]
    every = isinstance(tree, All)
    pick = F.least if every else F.greatest

    def upto(k: int, f: Callable[[list[_Out]], Column]) -> Column:
        """f of the parts that ran: up to the first that fails (All) or holds (Any)."""
        here = f(outs[: k + 1])
        if k == len(outs) - 1:
            return here
        stop = ~outs[k].matched if every else outs[k].matched
        return F.when(stop, here).otherwise(upto(k + 1, f))

    return _Out(
        reduce(lambda a, b: a & b if every else a | b, [o.matched for o in outs]),
        upto(0, lambda xs: pick(*[x.score for x in xs]) if len(xs) > 1 else xs[0].score),
        upto(0, lambda xs: F.concat(*[x.evidence for x in xs])),
        upto(0, lambda xs: reduce(lambda a, b: a + b, [x.evaluated for x in xs])),
    )


def evaluate(inputs: DataFrame, rules: list[Rule], order: str = "cost_ascending", evidence: str = "match_only", mode: str = "all", turn_window=None) -> DataFrame:
    """A row per input and rule: rule_id, matched, score, evidence, evaluated, total, short_circuited.

    inputs(source_id, text, …) may have speaker_role, channel within metadata, features(map) and metadata(map).
    order: cost_ascending, declaration or priority (rules with the higher priority first). evidence: match_only
    drops that of tests that did not match. mode: short_circuit keeps a row's rules up to the first that matches.
    A rule that matches through NOT alone has no evidence, and is a match all the same.
    """
    if order == "priority":
        rules = sorted(rules, key=lambda r: -r.priority)
    scope = Scope(set(inputs.columns), turn_window=turn_window)
    base = inputs.withColumn("_folded", T.fold(F.coalesce("text", F.lit("")))).withColumn("_tokens", T.words(F.col("_folded")))
    leaves: dict[Test, str] = {}
    for r in rules:
        for t in tests_of(r.tree):
            leaves.setdefault(t, f"_t{len(leaves)}")
    columns = {}
    for t, name in leaves.items():
        m, s, text = _test(t, scope)
        columns[name] = F.struct(F.coalesce(m, F.lit(False)).alias("m"), F.coalesce(s, F.lit(0.0)).alias("s"), text.alias("t"))
    base = base.withColumns(columns)

    def leaf(t: Test) -> _Out:
        x = F.col(leaves[t])
        item = F.struct(F.lit(t.family).alias("family"), F.lit(t.field).alias("field"), F.lit(t.operator).alias("operator"), x["m"].alias("matched"), x["s"].alias("score"), F.lit(t.threshold).cast("double").alias("threshold"), x["t"].alias("matched_text"))
        return _Out(x["m"], x["s"], F.array(item), F.lit(1))

    each = []
    for k, r in enumerate(rules):
        out = _compose(r.tree, leaf, order == "cost_ascending")
        kept = F.filter(out.evidence, lambda e: e["matched"]) if evidence == "match_only" else out.evidence
        total = sum(1 for _ in tests_of(r.tree))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), out.score))
        each.append(F.struct(F.lit(k).alias("ord"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), out.matched.alias("matched"), score.alias("score"), kept.alias("evidence"), out.evaluated.alias("evaluated"), F.lit(total).alias("total"), (out.evaluated < total).alias("short_circuited")))
    results = F.array(*each)
    if mode == "short_circuit":
        first = F.array_position(F.transform(results, lambda x: x["matched"]), True)
        results = F.when(first > 0, F.slice(results, F.lit(1), F.greatest(first, F.lit(1)).cast("int"))).otherwise(results)
    keep = [c for c in inputs.columns if c not in ("features", "metadata")]
    return base.select(*keep, F.explode(results).alias("r")).select(*keep, "r.rule_id", "r.rule_name", "r.matched", "r.score", "r.evidence", "r.evaluated", "r.total", "r.short_circuited")


def executions(results: DataFrame) -> DataFrame:
    """Matches as rule executions; `negative` marks those without evidence."""
    return results.where("matched").withColumn("evidence", F.filter("evidence", lambda e: e["matched"])).withColumn("negative", F.size("evidence") == 0)


def metrics(results: DataFrame) -> DataFrame:
    """Per rule: evaluations, match rate, share short-circuited, tests run and their number."""
    return results.groupBy("rule_id").agg(F.count(F.lit(1)).alias("evaluations"), F.round(F.avg(F.col("matched").cast("int")), 4).alias("match_rate"), F.round(F.avg(F.col("short_circuited").cast("int")), 4).alias("short_circuit_rate"), F.sum("evaluated").alias("evaluated"), F.sum("total").alias("tests"))


def family_distribution(results: DataFrame) -> DataFrame:
    """How many pieces of evidence each of the four families gave."""
    found = results.select(F.explode("evidence").alias("e")).agg(*[F.count_if(F.col("e.family") == f).alias(f) for f in COST])
    return found


def fragments(evidence: Column) -> Column:
    """The parts of a text to mark, each once and in order: both words of `a ~ b (dist=n)` and `a → b`, the word of `a (xn)`, the items of a list."""

    def parts(e: Column) -> Column:
        text = F.coalesce(e["matched_text"], F.lit(""))
        near = F.split(F.regexp_replace(text, r"\s*\(dist=\d+\)", ""), " ~ ")
        pieces = F.when(F.contains(text, F.lit(" ~ ")), near).when(text.rlike(" (?:→|->) "), F.split(text, r"\s*(?:→|->)\s*"))
        pieces = pieces.when(text.rlike(r"\(x\d+\)"), F.array(F.regexp_replace(text, r"\s*\(x\d+\)", ""))).when(F.contains(text, F.lit(", ")), F.split(text, ", "))
        return F.filter(F.transform(pieces.otherwise(F.array(text)), lambda x: F.trim(x)), lambda x: x != "")

    return F.array_distinct(F.flatten(F.transform(evidence, parts)))


def analyse(rule: Rule) -> dict:
    """What a rule is made of, and warnings, before it runs."""
    tests = list(tests_of(rule.tree))
    families = sorted({t.family for t in tests}, key=COST.get)
    warnings = [f"{t.operator} compiles and never matches" for t in tests if t.operator.startswith("window_")]
    warnings += ["a pattern with accents meets folded text" for t in tests if t.operator == "regex" and T.fold_text(str(t.value)) != str(t.value).lower()]
    n = len(tests)
    return {"families": families, "predicates": n, "complexity": "simple" if n <= 2 else "moderate" if n <= 5 else "complex", "warnings": warnings}
