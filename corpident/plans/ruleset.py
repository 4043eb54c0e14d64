"""A loaded bundle as a ruleset: its dispatchers as tables, its programs as expressions.

The expressions pick a program by kind or by target, so they grow with the bundle, whose
checks bound it; the catalog's own rules stay rows (see tables.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpident.operators import assertions, outcomes

from . import checks
from .language import Context, compile_program


@dataclass
class Dispatch:
    kinds: DataFrame  # k_token, k_kind, k_specific, k_fallback
    countries: DataFrame  # c_key, c_country, c_target
    prefixes: DataFrame  # p_key, p_prefix, p_target
    prefix_lengths: list[int]  # the longest first
    rules: DataFrame  # target, r_country, r_profile, r_absence


def _pick(key: str, cases: dict[str, Column], type_: str) -> Column:
    out = F.lit(None).cast(type_)
    for name, c in cases.items():
        out = F.when(F.col(key) == name, c.cast(type_)).otherwise(out)
    return out


class Ruleset:
    """Rules of a bundle that plans.checks accepts; pass it to validate or canonicalize."""

    def __init__(self, data: bytes):
        self.bundle = checks.load(data)
        self.version: str = self.bundle["rules_version"]
        self._programs = {p["id"]: p for p in self.bundle.get("programs", [])}

    @cached_property
    def _targets(self) -> dict[str, tuple[dict, dict]]:
        """kind/country: the target and its definition."""
        own = {d["id"]: d for d in self.bundle.get("definitions", [])}
        return {f"{d['kind']}/{t['country']}": (t, own[t["definition"]]) for d in self.bundle.get("dispatchers", []) for t in d["targets"]}

    def _compiled(self, program: int) -> Callable[[Context], Any]:
        return compile_program(self._programs[program], self._programs)

    def tables(self, spark: SparkSession) -> Dispatch:
        kinds, countries, prefixes = [], [], []
        for d in self.bundle.get("dispatchers", []):
            kind, targets = d["kind"], d["targets"]
            bare = [t["country"] for t in targets if not t.get("prefixes")]
            specific = all(t["country"] != "GLOBAL" for t in targets)
            kinds += [(token, kind, specific, f"{kind}/{bare[0]}" if len(bare) == 1 else None) for token in (kind, *d.get("aliases", []))]
            own = {t["country"]: t["country"] for t in targets if t["country"] != "GLOBAL"} | d.get("country_aliases", {})
            countries += [(f"{kind}/{asked}", c, f"{kind}/{c}") for asked, c in own.items()]
            prefixes += [(f"{kind}/{p}", p, f"{kind}/{t['country']}") for t in targets for p in t.get("prefixes", [])]
        rules = [(name, None if t["country"] == "GLOBAL" else t["country"], d["default_profile"], d.get("absence")) for name, (t, d) in self._targets.items()]
        return Dispatch(
            spark.createDataFrame(kinds, "k_token string, k_kind string, k_specific boolean, k_fallback string"),
            spark.createDataFrame(countries, "c_key string, c_country string, c_target string"),
            spark.createDataFrame(prefixes, "p_key string, p_prefix string, p_target string"),
            sorted({len(p) for _, p, _ in prefixes}, reverse=True),
            spark.createDataFrame(rules, "target string, r_country string, r_profile string, r_absence string"),
        )

    def _context(self, t: dict, value: Column, profile: Column | None = None) -> Context:
        country = F.lit(None if t["country"] == "GLOBAL" else t["country"]).cast("string")
        known = {} if profile is None else {"profile": profile}
        return Context(value, country=country, prefixes=tuple(t.get("prefixes", [])), prefix=t.get("canonical_prefix", ""), **known)

    def pre(self, value: Column) -> Column:
        """The pre-canonical value, by k_kind."""
        return _pick("k_kind", {d["kind"]: self._compiled(d["pre_canonicalization"])(Context(value))(value) for d in self.bundle.get("dispatchers", [])}, "string")

    def canonical(self, value: Column, profile: Column) -> Column:
        """The canonical value, by target."""
        return _pick("target", {name: self._compiled(d["canonicalization"])(self._context(t, value, profile))(value) for name, (t, d) in self._targets.items()}, "string")

    def format(self, value: Column, profile: Column) -> Column:
        """Why the format is invalid, by target; NULL if it is not."""
        return _pick("target", {name: self._compiled(d["format"])(self._context(t, value, profile)) for name, (t, d) in self._targets.items()}, assertions.TYPE)

    def checksum(self, value: Column, profile: Column) -> Column:
        """The outcome, by target; NULL for definitions without a checksum."""
        return _pick("target", {name: self._compiled(d["checksum"])(self._context(t, value, profile)) for name, (t, d) in self._targets.items() if "checksum" in d}, outcomes.TYPE)
