"""Label sets and selectors as Column expressions.

A label set is array<struct<name, value>>: a sorted multimap, since a name may repeat. A selector
is compiled once on the driver into one boolean Column, which stays inside whole-stage codegen's
higher-order functions and is evaluated where the rows are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "array<struct<name:string,value:string>>"
_NAME = re.compile(r"[\w+./-]{2,64}(?::prefix)?")


@dataclass
class Selector:
    """Include: every name must match one of its values. Exclude: none may match. Value '' means any value."""

    include: dict[str, list[str]] = field(default_factory=dict)
    exclude: dict[str, list[str]] = field(default_factory=dict)

    def __str__(self) -> str:
        parts = []
        for names, negated in ((self.include, False), (self.exclude, True)):
            for name in sorted(names):
                values = sorted(set(names[name]))
                if values == [""]:
                    parts.append(("!" if negated else "") + name)
                elif len(values) == 1:
                    parts.append(f"{name}{'!=' if negated else '='}{values[0]}")
                else:
                    parts.append(f"{name} {'notin' if negated else 'in'} ({','.join(values)})")
        return ",".join(parts)


def _clauses(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def parse_selector(text: str) -> Selector:
    """`a=b`, `a==b`, `a!=b`, `a`, `!a`, `a in (b,c)`, `a notin (b,c)`, joined by commas; a name may end in `:prefix`."""
    out = Selector()
    clauses = _clauses(text)
    if clauses and not clauses[-1].strip():
        clauses.pop()
    for clause in clauses:
        c = clause.strip()
        if m := re.fullmatch(r"(\S+)\s+(in|not ?in)\s*\(([^)]*)\)", c):
            name, negated, values = m[1], m[2] != "in", [v.strip() for v in m[3].split(",")]
        elif m := re.fullmatch(r"([^=!\s]+)\s*(!=|==|=)\s*(.*)", c):
            name, negated, values = m[1], m[2] == "!=", [m[3]]
        elif c.startswith("!"):
            name, negated, values = c[1:].strip(), True, [""]
        else:
            name, negated, values = c, False, [""]
        if not _NAME.fullmatch(name) or any(re.search(r"[\s()]", v) for v in values):
            raise ValueError(f"no selector expression: {clause!r}")
        (out.exclude if negated else out.include).setdefault(name, []).extend(values)
    return out


def _has(labels: Column, name: str, values: list[str]) -> Column:
    prefix = name.endswith(":prefix")
    name = name.removesuffix(":prefix")

    def one(label: Column) -> Column:
        hit = F.lit(False)
        for v in values:
            hit = hit | (F.lit(True) if v == "" else label["value"].startswith(v) if prefix else label["value"] == v)
        return (label["name"] == name) & hit

    return F.exists(labels, one)


def matches(labels: Column | str, selector: str | Selector) -> Column:
    """Whether a label set is matched. A null set has no labels."""
    sel = parse_selector(selector) if isinstance(selector, str) else selector
    col = F.coalesce(F.col(labels) if isinstance(labels, str) else labels, F.array().cast(LABELS))
    out = F.lit(True)
    for name, values in sel.include.items():
        out = out & _has(col, name, values)
    for name, values in sel.exclude.items():
        out = out & ~_has(col, name, values)
    return out


def label(name: str | Column, value: str | Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(name).alias("name"), as_col(value).alias("value"))


def label_set(*pairs: Column) -> Column:
    """Sorted and unique."""
    return normalize(F.array(*pairs).cast(LABELS))


def normalize(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(labels))


def with_meta(labels: Column, **meta: Column) -> Column:
    """Add meta-labels (name, prefix, id) before matching. They are no part of the stored set."""
    return F.concat(F.coalesce(labels, F.array().cast(LABELS)), F.array(*[label(k, v) for k, v in meta.items()]).cast(LABELS))


def journal_meta(labels: Column, name: Column) -> Column:
    """The meta-labels of a journal: its name, and each of its path prefixes is matched by prefix:prefix."""
    return with_meta(labels, name=name, prefix=name)


def values_of(labels: Column, name: str) -> Column:
    return F.transform(F.filter(labels, lambda x: x["name"] == name), lambda x: x["value"])


def value_of(labels: Column, name: str) -> Column:
    """The first value, or '' if the label is absent."""
    v = values_of(labels, name)
    return F.when(F.size(v) > 0, F.element_at(v, 1)).otherwise("")


def remove(labels: Column, name: str) -> Column:
    return F.filter(labels, lambda x: x["name"] != name)


def set_value(labels: Column, name: str, value: str | Column) -> Column:
    return normalize(F.concat(remove(labels, name), F.array(label(name, value)).cast(LABELS)))


def add_value(labels: Column, name: str, value: str | Column) -> Column:
    return normalize(F.concat(labels, F.array(label(name, value)).cast(LABELS)))


def names(labels: Column) -> Column:
    return F.array_distinct(F.transform(labels, lambda x: x["name"]))


def union(a: Column, b: Column) -> Column:
    """All names of both; where a name is in both, the values of `a` win."""
    have = names(a)
    return normalize(F.concat(a, F.filter(b, lambda x: ~F.array_contains(have, x["name"]))))


def _same_values(a: Column, b: Column, name: Column) -> Column:
    of = lambda s: F.array_sort(F.transform(F.filter(s, lambda x: x["name"] == name), lambda x: x["value"]))
    return of(a) == of(b)


def intersect(a: Column, b: Column) -> Column:
    """Names whose whole lists of values are equal in both."""
    return F.filter(a, lambda x: _same_values(a, b, x["name"]))


def subtract(a: Column, b: Column) -> Column:
    """`a` without the names whose lists of values are equal in both."""
    return F.filter(a, lambda x: ~_same_values(a, b, x["name"]))


def outer_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two tables (name, value) by name: name, left_values, right_values."""
    fold = lambda d, c: d.groupBy("name").agg(F.array_sort(F.collect_set("value")).alias(c))
    return fold(a, "left_values").join(fold(b, "right_values"), "name", "full_outer")


def problems(labels: Column) -> Column:
    """What is wrong with a label set: bad names or values, unsorted, or empty and other values mixed under a name."""
    bad_name = F.exists(labels, lambda x: ~x["name"].rlike(r"^[\p{L}\p{N}\-_+/.]{2,64}$"))
    bad_value = F.exists(labels, lambda x: ~x["value"].rlike(r"^[\p{L}\p{N}\-_+/.=%]{0,1024}$"))
    mixed = F.exists(labels, lambda x: (x["value"] == "") & (F.size(F.filter(labels, lambda y: y["name"] == x["name"])) > 1))
    found = F.array(F.when(bad_name, "name"), F.when(bad_value, "value"), F.when(normalize(labels) != labels, "order"), F.when(mixed, "mixed"))
    return F.filter(found, lambda x: x.isNotNull())
