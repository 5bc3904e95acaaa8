"""The rule language: conditions over event fields, parsed once on the driver and compiled to Column expressions.

    condition := conjunction ("or" conjunction)*       conjunction := negation ("and" negation)*
    negation  := "not" negation | "(" condition ")" | field operator value

Logic has two values: a predicate over a missing field is false and its negation true, so each leaf is made
non-null. Field names are case-sensitive, keywords are not.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.patterns import starts

#: The field names of the language.
NUMERIC = ("syscall_nr", "pid", "tid", "uid", "arg0", "arg1", "return_value")
TEXT = ("syscall_name", "event_id", "comm", "flags", "arg_flags", "hostname", "namespace")
ATTRIBUTES = (
    "attributes.fd_path", "attributes.fd_resource_kind", "attributes.fd_sock_local_addr", "attributes.fd_sock_local_port",
    "attributes.fd_sock_remote_addr", "attributes.fd_sock_remote_port", "attributes.fd_sock_family",
)
FIELDS = (*NUMERIC, *TEXT, *ATTRIBUTES)
OPERATORS = ("=", "in", "startswith", "startswithin", "contains")


def tokens(text: str) -> list[str]:
    """Marks ( ) , =, quoted strings with their quotes, and words: runs of anything else that isn't white space. A quote
    opens a string only where a token begins, and only if it is closed; within a word it is a character."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
            continue
        end = at + 1
        if c in "\"'" and text.find(c, at + 1) > 0:
            end = text.find(c, at + 1) + 1
        elif c not in "(),=":
            while end < len(text) and not text[end].isspace() and text[end] not in "(),=":
                end += 1
        out.append(text[at:end])
        at = end
    return out


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class All:
    of: tuple


@dataclass(frozen=True)
class Any:
    of: tuple


class _Parser:
    def __init__(self, text: str, lists: dict[str, tuple[str, ...]]):
        self.tokens, self.at, self.lists = tokens(text), 0, {k.lower(): v for k, v in lists.items()}

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token:
            raise ValueError("the condition ends too early")
        if expected is not None and token.lower() != expected:
            raise ValueError(f"expected {expected!r}, found {token!r}")
        self.at += 1
        return token

    def condition(self):
        return self._chain("or", lambda: self._chain("and", self.negation, All), Any)

    def _chain(self, word: str, part, kind):
        parts = [part()]
        while self.peek().lower() == word:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else kind(tuple(parts))

    def negation(self):
        if self.peek().lower() == "not":
            self.take()
            return Not(self.negation())
        if self.peek() == "(":
            self.take()
            inner = self.condition()
            self.take(")")
            return inner
        name, op = self.take(), self.take().lower()
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        if op == "startswithin" or (op == "in" and self.peek() == "("):
            return Predicate(name, op, self._listed())
        value = _bare(self.take())
        return Predicate(name, op, self.lists.get(value.lower(), (value,)) if op == "in" else (value,))

    def _listed(self) -> tuple[str, ...]:
        self.take("(")
        out: list[str] = []
        while self.peek() != ")":
            token = self.take()
            if token != ",":
                value = _bare(token)
                out += self.lists.get(value.lower(), (value,))
        self.take(")")
        return tuple(out)


def _bare(token: str) -> str:
    return token[1:-1] if token[:1] in "\"'" and token[-1:] == token[:1] and len(token) > 1 else token


def parse(text: str, lists: dict[str, tuple[str, ...]] | None = None, macros: dict[str, str] | None = None):
    """The condition's tree; None for an empty one, which holds for all events of its group."""
    text = expand(text, macros or {})
    if not text.strip():
        return None
    parser = _Parser(text, lists or {})
    tree = parser.condition()
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()!r}")
    return tree


def expand(text: str, macros: dict[str, str], _open: tuple[str, ...] = ()) -> str:
    """Macro names replaced by their bodies in parentheses, longer names first; only macros in use are looked at."""
    for name in sorted(macros, key=len, reverse=True):
        word = re.compile(rf"(?<![\w.]){re.escape(name)}(?![\w.])")
        if word.search(text):
            if name in _open:
                raise ValueError(f"macro {name!r} refers to itself")
            body = expand(macros[name], macros, (*_open, name))
            text = word.sub(lambda _, b=body: f"({b})", text)
    return text


def _value(name: str, columns: list[str]) -> Column:
    if name == "arg_flags" and name not in columns:  # stands for flags where there is none of its own
        name = "flags"
    if name.startswith("attributes."):
        return F.try_element_at("attributes", F.lit(name.split(".", 1)[1]))
    if name in columns:
        return F.col(name)
    if name in ("return_value", "flags") and "attributes" in columns:
        return F.try_element_at("attributes", F.lit(name))
    return F.lit(None).cast("string")


def _int(text: str) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def leaf(p: Predicate, columns: list[str]) -> Column:
    """May be null where the field is missing."""
    c = _value(p.field, columns)
    if p.field in NUMERIC:
        if p.op not in ("=", "in"):
            return F.lit(False)
        ints = [i for i in map(_int, p.values) if i is not None]
        return c.cast("string").try_cast("bigint").isin(ints) if ints else F.lit(False)
    tests = {"=": lambda v: c == v, "in": lambda v: c == v, "startswith": c.startswith, "contains": c.contains}
    if p.op == "in":
        return c.isin(list(p.values)) if p.values else F.lit(False)
    if p.op == "startswithin":
        return starts(c, p.values)
    return reduce(lambda x, y: x | y, [tests[p.op](v) for v in p.values], F.lit(False)) if p.values else F.lit(False)


def compile_(tree, columns: list[str]) -> Column:
    """A Column that is never null."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Not):
        return ~compile_(tree.of, columns)
    if isinstance(tree, All):
        return reduce(lambda x, y: x & y, [compile_(t, columns) for t in tree.of])
    if isinstance(tree, Any):
        return reduce(lambda x, y: x | y, [compile_(t, columns) for t in tree.of])
    return F.coalesce(leaf(tree, columns), F.lit(False))


def _text(value: str) -> str:
    """A literal in Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_text(tree) -> str:
    """The condition in Spark's SQL, never null, over parameters named as the fields, and ``attributes``."""
    if tree is None:
        return "true"
    if isinstance(tree, Not):
        return f"not {sql_text(tree.of)}"
    if isinstance(tree, (All, Any)):
        return "(" + (" and " if isinstance(tree, All) else " or ").join(map(sql_text, tree.of)) + ")"
    name = tree.field
    c = f"try_element_at(attributes, {_text(name.split('.', 1)[1])})" if name.startswith("attributes.") else name
    if name in ("return_value", "flags"):
        c = f"coalesce({name}, try_element_at(attributes, {_text(name)}))"
    if name == "arg_flags":
        c = "coalesce(arg_flags, flags)"
    if name in NUMERIC:
        ints = [str(i) for i in map(_int, tree.values) if i is not None] if tree.op in ("=", "in") else []
        test = f"try_cast({c} as bigint) in ({', '.join(ints)})" if ints else "false"
    elif tree.op in ("=", "in"):
        test = f"{c} in ({', '.join(map(_text, tree.values))})" if tree.values else "false"
    else:
        call = "contains" if tree.op == "contains" else "startswith"
        test = " or ".join(f"{call}({c}, {_text(v)})" for v in tree.values) or "false"
    return f"coalesce({test}, false)"


#: Parameters of the classifier in SQL.
PARAMETERS = (*[n for n in (*NUMERIC, *TEXT)], "attributes")


def register_sql(spark: SparkSession, rules: Rules, name: str = "rule_of", numbers: dict[str, int] | None = None) -> None:
    """A function of this session's SQL that gives the name of the first rule that admits an event, null if none does. It
    takes PARAMETERS in their order: texts, but for the call's number and the map of attributes."""
    known, cases = NUMBERS if numbers is None else numbers, []
    for r in rules.rules:
        if r.enabled:
            calls = rules.groups[r.group].syscalls
            own = [str(known[c]) for c in calls if c in known]
            member = [f"lower(trim(syscall_name)) in ({', '.join(map(_text, calls))})"] * bool(calls) + [f"syscall_nr in ({', '.join(own)})"] * bool(own)
            cases.append(f"when ({' or '.join(f'coalesce({m}, false)' for m in member) or 'false'}) and {sql_text(parse(r.condition, rules.lists, rules.macros))} then {_text(r.name)}")
    kinds = {"syscall_nr": "bigint", "attributes": "map<string, string>"}
    body = f"case {' '.join(cases)} end" if cases else "cast(null as string)"
    spark.sql(f"create or replace temporary function {name}({', '.join(f'{p} {kinds.get(p, 'string')}' for p in PARAMETERS)}) returns string return {body}")


@dataclass(frozen=True)
class Group:
    syscalls: tuple[str, ...] = ()
    features: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    name: str
    group: str
    condition: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Rules:
    lists: dict[str, tuple[str, ...]]
    macros: dict[str, str]
    groups: dict[str, Group]
    rules: tuple[Rule, ...]


def load(spec: dict | str) -> Rules:
    """Rules from YAML text or its mapping, with every reference checked."""
    if isinstance(spec, str):
        import yaml

        spec = yaml.safe_load(spec)
    if not isinstance(spec, dict):
        raise ValueError("rules must be a mapping")
    lists = {}
    for name, items in (spec.get("lists") or {}).items():
        if not isinstance(items, list):
            raise ValueError(f"list {name!r} must be a list")
        lists[_name(name, "list")] = tuple(str(i).strip().lower() for i in items)
    macros = {}
    for name, body in (spec.get("macros") or {}).items():
        if not isinstance(body, str) or not body.strip():
            raise ValueError(f"macro {name!r} must be a non-empty string")
        macros[str(name).strip()] = body
    groups = {}
    for name, g in (spec.get("groups") or {}).items():
        if not isinstance(g, dict) or "syscalls" not in g:
            raise ValueError(f"group {name!r} must have syscalls")
        calls = g["syscalls"]
        if isinstance(calls, str):
            if calls.strip().lower() not in lists:
                raise ValueError(f"group {name!r} refers to the unknown list {calls!r}")
            calls = lists[calls.strip().lower()]
        calls = tuple(c for s in calls for c in lists.get(str(s).strip().lower(), (str(s).strip().lower(),)))
        groups[_name(name, "group")] = Group(calls, {k: tuple(str(x).lower() for x in v) for k, v in (g.get("features") or {}).items()})
    rules, seen = [], set()
    for r in spec.get("rules") or []:
        if not isinstance(r, dict) or not str(r.get("name") or "").strip():
            raise ValueError("every rule needs a name")
        for old in ("syscalls", "priority", "output"):
            if old in r:
                raise ValueError(f"rule {r['name']!r}: {old!r} is no longer a field of rules")
        if r["name"] in seen:
            raise ValueError(f"two rules are named {r['name']!r}")
        seen.add(r["name"])
        group = str(r.get("group") or "").strip().lower()
        if group not in groups:
            raise ValueError(f"rule {r['name']!r} is in the unknown group {group!r}")
        rule = Rule(str(r["name"]), group, str(r.get("condition") or ""), bool(r.get("enabled", True)))
        parse(rule.condition, lists, macros)
        rules.append(rule)
    out = Rules(lists, macros, groups, tuple(rules))
    _no_overlap(out)
    return out


def _name(name: object, what: str) -> str:
    name = str(name).strip().lower()
    if not name:
        raise ValueError(f"a {what} has no name")
    return name


def _no_overlap(rules: Rules) -> None:
    of: dict[str, str] = {}
    for g in dict.fromkeys(r.group for r in rules.rules if r.enabled):
        for call in rules.groups[g].syscalls:
            if of.setdefault(call, g) != g:
                raise ValueError(f"{call!r} is in the groups {of[call]!r} and {g!r}, which both have enabled rules")


def matches(rules: Rules, columns: list[str], numbers: dict[str, int] | None = None) -> list[tuple[Rule, Column]]:
    """Each enabled rule with its full condition: its group's calls, by name or by number, and its own. numbers: of
    calls by name, as ``call_numbers`` reads them from a table of the machine; by default those of the view."""
    out, known = [], NUMBERS if numbers is None else numbers
    for r in rules.rules:
        if r.enabled:
            calls = list(rules.groups[r.group].syscalls)
            member = F.coalesce(F.lower(F.trim("syscall_name")).isin(calls), F.lit(False))
            if own := [known[c] for c in calls if c in known]:
                member = member | F.coalesce(F.col("syscall_nr").isin(own), F.lit(False))
            out.append((r, member & compile_(parse(r.condition, rules.lists, rules.macros), columns)))
    return out


#: Numbers of the calls that the view has.
NUMBERS = {"read": 0, "write": 1, "open": 2, "close": 3, "socket": 41, "connect": 42, "execve": 59, "unlink": 87, "openat": 257}


def call_numbers(table: str) -> dict[str, int]:
    """Numbers of calls by name, from lines such as ``#define __NR_read 0`` or ``read 0``; other lines don't count."""
    return {m[1].lower(): int(m[2]) for m in re.finditer(r"(?m)^\s*(?:#define\s+__NR_)?([a-z]\w*)\s+(\d+)\s*$", table)}


def numbered(events: DataFrame, numbers: dict[str, int], unknown: int = 0) -> DataFrame:
    """Append syscall_nr by the call's name; what has none gets ``unknown``. The table is a few hundred rows at most."""
    rows = [(k, v) for k, v in numbers.items()] or [("", unknown)]
    known = events.sparkSession.createDataFrame(rows, "call string, nr long")
    out = events.drop("syscall_nr").join(F.broadcast(known), F.lower(F.trim("syscall_name")) == F.col("call"), "left")
    return out.withColumn("syscall_nr", F.coalesce("nr", F.lit(unknown).cast("long"))).drop("call", "nr")


def prefilter(events: DataFrame, tuples: list[dict[str, str | int]], most: int = 24) -> DataFrame:
    """Events that one of the tuples admits, ahead of the rules: each gives any of syscall_nr, pid, tid, uid, comm and
    path_prefix, all of which must hold; none at all admits everything. Plain comparisons, so that the scan sees them."""
    if len(tuples) > most:
        raise ValueError(f"at most {most} tuples, not {len(tuples)}")
    fields = {"syscall_nr", "pid", "tid", "uid", "comm", "path_prefix"}
    admitted = F.lit(not tuples)
    for t in tuples:
        if bad := set(t) - fields:
            raise ValueError(f"unknown fields {sorted(bad)}")
        one = F.lit(True)
        for k, v in t.items():
            one = one & F.coalesce(_value("attributes.fd_path", events.columns).startswith(str(v)) if k == "path_prefix" else F.col(k) == v, F.lit(False))
        admitted = admitted | one
    return events.where(admitted)


class RuleFile:
    """Rules in a text file in any store that Spark reads, read again when the file has changed: call ``current`` once a
    micro-batch. Where the new text is no good, the old rules stay, and ``error`` says why."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stamp, self.error = spark, path, None, None
        self.rules: Rules | None = None

    def _read(self) -> tuple[object, str]:
        r = self.spark.read.format("binaryFile").load(self.path).select("modificationTime", "length", "content").first()
        if r is None:
            raise ValueError(f"{self.path} is not there")
        return (r[0], r[1]), bytes(r[2]).decode()

    def current(self) -> Rules:
        try:
            stamp, text = self._read()
            if stamp != self.stamp:
                self.rules, self.error = load(text), None
                self.stamp = stamp
        except Exception as e:  # whatever is wrong with the file, a running stream goes on
            if self.rules is None:
                raise
            self.error = str(e)
        return self.rules


def classify_stream(events: DataFrame, file: RuleFile, sink: Callable[[DataFrame, int], None]):
    """A stream's writer that classifies each micro-batch by the rules as they are then, and hands it to ``sink``."""
    return events.writeStream.foreachBatch(lambda batch, n: sink(classify(batch, file.current()), n))


def classify(events: DataFrame, rules: Rules, numbers: dict[str, int] | None = None) -> DataFrame:
    """Events that some rule allows, with rule and rule_group of the first that does."""
    cases = matches(rules, events.columns, numbers)
    if not cases:
        return events.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_group", F.lit(None).cast("string")).limit(0)
    first = lambda get: reduce(lambda acc, c: acc.when(c[1], F.lit(get(c[0]))), cases[1:], F.when(cases[0][1], F.lit(get(cases[0][0]))))
    out = events.where(reduce(lambda x, y: x | y, [c for _, c in cases]))
    return out.withColumn("rule", first(lambda r: r.name)).withColumn("rule_group", first(lambda r: r.group))


#: Groups of calls that no rule names.
NETWORK_CALLS = ("accept", "accept4", "bind", "connect", "getpeername", "getsockname", "getsockopt", "listen", "recvfrom", "recvmsg", "recvmmsg", "sendmmsg", "sendmsg", "sendto", "setsockopt", "shutdown", "socket", "socketpair")


def inferred_group(name: Column, rules: Rules, fallback: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The group of a call: that of the rules, else of the fallback sets in their order, else empty."""
    out, call = F.lit(""), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for group, calls in reversed((fallback or {"network": NETWORK_CALLS}).items()):
        out = F.when(call.isin(list(calls)), F.lit(group)).otherwise(out)
    for c, group in group_of_syscall(rules).items():
        out = F.when(call == c, F.lit(group)).otherwise(out)
    return out


def group_of_syscall(rules: Rules) -> dict[str, str]:
    """The group of the first enabled rule for each call, whatever its condition."""
    out: dict[str, str] = {}
    for r in rules.rules:
        if r.enabled:
            for c in rules.groups[r.group].syscalls:
                out.setdefault(c, r.group)
    return out
