"""Column functions on paths, sizes, permissions and rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The whole text: * is any run of characters, '/' too, ? is one; nothing else is special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\z"


def matches(path: Column, rule: tuple[str, str]) -> Column:
    """rule: glob, regex or prefix, and its text. A regex that isn't valid matches nothing."""
    kind, text = rule
    if kind == "glob":
        return path.rlike(glob_regex(text))
    if kind == "prefix":
        return path.startswith(text)
    if kind != "regex":
        raise ValueError(f"no rule of kind {kind!r}")
    try:
        re.compile(text)
    except re.error:
        return F.lit(False)
    return path.rlike(text)


def aligned(rule: tuple[str, str]) -> tuple[str, str]:
    """rule with forward slashes; raises ValueError for empty or impossible ones."""
    kind, text = rule
    text = text if kind == "regex" else text.replace("\\", "/")
    if not text or kind == "glob" and any(c in text for c in '|<>"'):
        raise ValueError(f"not a {kind}: {text!r}")
    if kind == "regex":
        re.compile(text)
    return kind, text


def passes(path: Column, include: list[tuple[str, str]], exclude: list[tuple[str, str]]) -> Column:
    """No exclude rule matches, and some include rule does or there is none."""
    out = ~_any([matches(path, r) for r in exclude]) if exclude else F.lit(True)
    return out & _any([matches(path, r) for r in include]) if include else out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def selected(kind: str, *args) -> Column:
    """Files to restore by path or mtime: all, list, glob, substring, prefix, between (both ends included)."""
    path = F.col("path")
    rules = {
        "all": lambda: F.lit(True), "list": lambda *paths: path.isin(list(paths)), "glob": lambda g: path.rlike(glob_regex(g)),
        "substring": lambda s: path.contains(s), "prefix": lambda p: path.startswith(p), "between": lambda a, b: F.col("mtime").between(a, b),
    }
    if kind not in rules:
        raise ValueError(f"no selection {kind!r}")
    return rules[kind](*args)


def format_bytes(n: Column) -> Column:
    """12 B, 1.50 KB and so on by 1024; '-' for null or negative."""
    n = n.cast("double")
    out = F.when(n.isNull() | (n < 0), "-").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = F.format_string(f"%.2f {unit}", n / F.lit(float(1024**k)))
        out = out.when(n < 1024.0 ** (k + 1), value) if unit != "TB" else out.otherwise(value)
    return out


def permitted(held: Column, wanted: str) -> Column:
    """Does an array of permissions hold '*', the wanted one, or 'prefix:*' of it."""
    return F.exists(held, lambda p: (p == "*") | (p == wanted) | (p.endswith(":*") & F.lit(wanted).startswith(p.substr(F.lit(1), F.length(p) - 1))))


def compares(op: Column, value: Column, limit: Column) -> Column:
    """The comparison that op names; false for an unknown one."""
    out = F.when(op == ">", value > limit).when(op == ">=", value >= limit).when(op == "<", value < limit)
    return F.coalesce(out.when(op == "<=", value <= limit).when(op == "==", value == limit), F.lit(False))


def backoff(attempt: Column, initial: float, factor: float, most: float, max_retries: int) -> Column:
    """Seconds before a retry; null once max_retries are used up."""
    return F.when(attempt <= max_retries, F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most)))


def repository_backoff(attempt: Column, initial_s: float = 1.0, most_s: float = 30.0, max_retries: int = 5) -> Column:
    """Seconds before attempt (from 0) of a repository call is made again, doubling; null for the last one and for errors of no passing kind."""
    return F.when(attempt < max_retries, F.least(F.lit(initial_s) * F.pow(F.lit(2.0), attempt), F.lit(most_s)))


def retryable(kind: Column) -> Column:
    """Only input/output errors and failures pass by themselves."""
    return F.coalesce(F.lower(kind).isin("io", "failed"), F.lit(False))


def holds(column: Column, term: str | None) -> Column:
    """Does column hold term, whatever the case; without a term everything does."""
    return F.lit(True) if not term else F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))


def holds_exactly(term: str | None, *columns: str) -> Column:
    """Does one of the columns hold term in this very case; without a term everything does."""
    return F.lit(True) if not term else _any([F.coalesce(F.contains(F.col(c), F.lit(term)), F.lit(False)) for c in columns])


def within(at: Column, start: str | None, end: str | None) -> Column:
    """Both ends included; an end that is None is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (at >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out & (at <= F.lit(end).cast("timestamp_ntz"))


def restore_path(base: str, path: Column, rename: bool = False) -> Column:
    """Under base with its folders kept; renamed files get the suffix .restored."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(path, F.lit("/")), F.lit(".restored" if rename else ""))


def path_levels(path: Column) -> Column:
    """The folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
