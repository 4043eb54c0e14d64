"""The catalog as small DataFrames, one row per alias, country, prefix, rule and rule with lists. Their sizes
are fixed by the catalog (under two hundred rows each), so joins to them are broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import catalog
from .model import BASES, DIGITS, Branch, Check, Definition, Sum, Test, View

TEST = "op string, base int, start int, stop int, text string, least int, most int, negated boolean"
SUM = (
    "kind string, base int, start int, stop int, weights array<bigint>, alignment string, alphabet string, modulus bigint, complement boolean, "
    "remainders array<bigint>, terms array<struct<power: bigint; weight: bigint>>, against string, constant bigint, d_base int, d_start int, d_stop int, key string, reason string"
)


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(", "))).replace("; ", ", ") + ">"


TEST_TYPE, SUM_TYPE = _struct(TEST), _struct(SUM)
CHECK_TYPE = f"struct<alternatives: array<array<{TEST_TYPE}>>, reason: string, key: string>"
BRANCH_TYPE = f"struct<any_of: array<{SUM_TYPE}>, tests: array<{TEST_TYPE}>, sums: array<{SUM_TYPE}>>"
#: What every row carries along: little, since rows are copied between stages.
RULE = (
    "target string, r_country string, r_profile string, r_euid string, r_upper boolean, r_remove string, r_replace string, r_replacement string, r_prepend boolean, "
    "r_prefixes array<string>, r_prefix string, r_insert_length int, r_insert_at int, r_insert string, "
    "r_empty string, r_length string, r_spans array<struct<least: int, most: int>>, r_start string, r_starts string, r_chars string, r_alphabet string, r_from int, r_list string, r_absence string"
)
#: What is joined only where it is evaluated.
LISTS = f"l_target string, l_rest array<{CHECK_TYPE}>, l_sum {SUM_TYPE}, l_parts array<array<{BRANCH_TYPE}>>"


def _view(v: View) -> tuple:
    return (BASES.index(v.base), v.start, v.end)


def _test(t: Test) -> tuple:
    return (t.op, *_view(t.view), t.text, t.least, t.most, t.negated)


def _sum(s: Sum) -> tuple:
    table = None if s.table is None else list(s.table)
    return (s.kind, *_view(s.view), list(s.weights), s.alignment, s.alphabet, s.modulus, s.complement, table, _terms(s), s.against, s.constant, *_view(s.digits), s.key, s.reason)


def _check(c: Check) -> tuple:
    return ([[_test(t) for t in a] for a in c.alternatives], c.reason, c.key)


#: The checks most definitions begin with, in this order; each may be left out.
HEAD = {"empty": "empty", "length": "invalid_length", "prefix": "invalid_format", "chars": "invalid_characters"}


def _head(checks: tuple[Check, ...]) -> tuple[dict[str, tuple[Test, str]], tuple[Check, ...]]:
    """The common checks that come first, as operation: (test, key), and the rest."""
    out: dict[str, tuple[Test, str]] = {}
    slots = list(HEAD)
    for i, c in enumerate(checks):
        t = c.alternatives[0][0]
        op = "length" if t.op == "lengths" else t.op
        alone = len(c.alternatives) == len(c.alternatives[0]) == 1 and t.negated == (op == "empty")
        whole = t.view.base == "whole" and t.view.end is None and (op == "chars" or t.view.start == 0)
        if not (alone and whole and op in slots and HEAD[op] == c.reason):
            return out, checks[i:]
        out[op] = (t, c.key)
        slots = slots[slots.index(op) + 1 :]
    return out, ()


def _terms(s: Sum) -> list[tuple[int, int]] | None:
    """Powers of ten and weights, where places of one number can give the sum: of digits in a
    view of known length, or from its right end."""
    n, known = len(s.weights), s.view.end is not None and s.view.end >= 0
    last = n if s.alignment == "right" else s.view.end - s.view.start if known else 0
    fits = s.kind == "weighted" and s.alphabet == DIGITS and n <= 18 and (s.alignment == "right" or s.alignment == "left" and n <= last <= 18)
    return [(10 ** (last - 1 - i), w) for i, w in enumerate(s.weights)] if fits else None


def _alone(d: Definition) -> Sum | None:
    """The only sum of a checksum that has no more."""
    if isinstance(d.checksum, str) or len(d.checksum) != 1 or len(d.checksum[0]) != 1:
        return None
    b = d.checksum[0][0]
    return None if b.tests or b.sums or len(b.any_of) != 1 else b.any_of[0]


def _branch(b: Branch) -> tuple:
    return ([_sum(s) for s in b.any_of], [_test(t) for t in b.tests], [_sum(s) for s in b.sums])


def _rule(d: Definition) -> tuple:
    c = d.canonical
    head, _ = _head(d.checks)
    none = (Test("none"), None)
    (_, k_empty), (size, k_length), (start, k_start), (body, k_chars) = (head.get(op, none) for op in HEAD)
    listed = {t.text for x in d.checks for a in x.alternatives for t in a if t.op == "listed"}
    sizes = [(size.least, size.most)] if size.op == "length" else [(int(n), int(n)) for n in (size.text or "").split("/") if n]
    country = None if d.country == "GLOBAL" else d.country
    return (
        f"{d.kind}/{d.country}", country, d.default_profile, country if d.kind == "euid" else None,
        c.upper, c.remove, *(c.replace or (None, None)), c.prepend_country, list(d.prefixes), d.prefix, *(c.insert_when or (None, None, None)),
        k_empty, k_length, sizes, k_start, start.text, k_chars, body.text, body.view.start, next(iter(listed), None),
        d.checksum if isinstance(d.checksum, str) else None,
    )


def _lists(d: Definition) -> tuple | None:
    """The nested part of a rule, for those that have one."""
    alone, (_, rest) = _alone(d), _head(d.checks)
    parts = None if isinstance(d.checksum, str) or alone else [[_branch(b) for b in part] for part in d.checksum]
    return (f"{d.kind}/{d.country}", [_check(x) for x in rest] or None, _sum(alone) if alone else None, parts) if rest or alone or parts else None


@dataclass
class Tables:
    kinds: DataFrame  # k_token, k_kind, k_remove, k_specific, k_fallback
    countries: DataFrame  # c_key, c_country, c_target
    prefixes: DataFrame  # p_key, p_prefix, p_target
    prefix_lengths: list[int]  # the longest first
    rules: DataFrame  # see RULE
    lists: DataFrame  # see LISTS


def tables(spark: SparkSession, definitions: list[Definition] | None = None) -> Tables:
    rules = catalog.definitions() if definitions is None else definitions
    kinds, countries, prefixes = [], [], []
    for kind, aliases in catalog.KINDS.items():
        own = [d for d in rules if d.kind == kind]
        if not own:
            continue
        bare = [d for d in own if not d.prefixes]
        fallback = f"{kind}/{bare[0].country}" if len(bare) == 1 else None
        specific = all(d.country != "GLOBAL" for d in own)
        # EUIDs keep their separators before a country is known
        remove = "" if kind == "euid" else "-./_"
        kinds += [(t, kind, remove, specific, fallback) for t in (kind, *aliases)]
        by_country = {d.country: f"{kind}/{d.country}" for d in own if d.country != "GLOBAL"}
        also = {a: c for a, c in catalog.COUNTRY_ALIASES.get(kind, {}).items() if c in by_country}
        countries += [(f"{kind}/{c}", c, t) for c, t in by_country.items()]
        countries += [(f"{kind}/{a}", c, by_country[c]) for a, c in also.items()]
        prefixes += [(f"{kind}/{p}", p, f"{kind}/{d.country}") for d in own for p in d.prefixes]
    return Tables(
        spark.createDataFrame(kinds, "k_token string, k_kind string, k_remove string, k_specific boolean, k_fallback string"),
        spark.createDataFrame(countries, "c_key string, c_country string, c_target string"),
        spark.createDataFrame(prefixes, "p_key string, p_prefix string, p_target string"),
        sorted({len(p) for _, p, _ in prefixes}, reverse=True),
        spark.createDataFrame([_rule(d) for d in rules], RULE),
        spark.createDataFrame([x for d in rules if (x := _lists(d))], LISTS),
    )
