"""How rules are written down.

A rule is data, so that one generic expression evaluates all of them and adding a rule adds a
row. A view is a part of the canonical value ("whole"), of what stands between a EUID's
country and its first full stop ("register"), or after that stop ("tail"); negative places
count from the end, an end of None is open. A test is a condition on a view. A check holds if all tests of
one of its alternatives do. A checksum is a list of parts that must all pass; the first branch
of a part that applies decides it, by any of its sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from corpident.operators.alphabets import BASE36, DIGITS

BASES = ("whole", "register", "tail")


@dataclass(frozen=True)
class View:
    start: int = 0
    end: int | None = None
    base: str = "whole"

    def on(self, outer: View) -> View:
        """This view of what outer, a suffix, shows."""
        return View(self.start if self.start < 0 else self.start + outer.start, None if self.end is None else self.end if self.end < 0 else self.end + outer.start, outer.base)


@dataclass(frozen=True)
class Test:
    op: str  # empty, length, lengths, chars, prefix, contains, absent, listed, profile
    view: View = View()
    text: str | None = None
    least: int = 0
    most: int = 0
    negated: bool = False

    def __invert__(self) -> Test:
        return replace(self, negated=not self.negated)

    def on(self, outer: View) -> Test:
        return replace(self, view=self.view.on(outer))


@dataclass(frozen=True)
class Check:
    alternatives: tuple[tuple[Test, ...], ...]
    reason: str
    key: str

    def on(self, outer: View) -> Check:
        return replace(self, alternatives=tuple(tuple(t.on(outer) for t in a) for a in self.alternatives))


@dataclass(frozen=True)
class Sum:
    """A number from a view, and what it is held against."""

    kind: str  # luhn, mod97, weighted, number, unsupported
    view: View = View()
    weights: tuple[int, ...] = ()
    alignment: str = "left"
    alphabet: str = DIGITS
    modulus: int | None = None
    complement: bool = False
    table: tuple[int, ...] | None = None
    against: str = "constant"  # constant, digits
    constant: int = 0
    digits: View = View()
    key: str | None = None
    reason: str | None = None

    def on(self, outer: View) -> Sum:
        return replace(self, view=self.view.on(outer), digits=self.digits.on(outer))


@dataclass(frozen=True)
class Branch:
    any_of: tuple[Sum, ...]
    tests: tuple[Test, ...] = ()
    sums: tuple[Sum, ...] = ()  # apply only if these hold

    def on(self, outer: View) -> Branch:
        return Branch(tuple(s.on(outer) for s in self.any_of), tuple(t.on(outer) for t in self.tests), tuple(s.on(outer) for s in self.sums))


Checksum = tuple[tuple[Branch, ...], ...]


@dataclass(frozen=True)
class Canonical:
    """White space always goes; then, in this order, whatever is set."""

    upper: bool = True
    remove: str = ""
    replace: tuple[str, str] | None = None
    prepend_country: bool = False
    insert_when: tuple[int, int, str] | None = None  # length, place, text, if digits follow the place


@dataclass(frozen=True)
class Definition:
    kind: str
    country: str
    canonical: Canonical
    checks: tuple[Check, ...]
    checksum: Checksum | str  # or why there is none
    prefixes: tuple[str, ...] = ()
    prefix: str = ""
    default_profile: str = "compatible"


def empty(view: View = View()) -> Test:
    return Test("empty", view)


def length(least: int, most: int | None = None, view: View = View()) -> Test:
    return Test("length", view, least=least, most=least if most is None else most)


def chars(alphabet: str = DIGITS, view: View = View()) -> Test:
    return Test("chars", view, alphabet)


def at(index: int, alphabet: str) -> Test:
    return Test("chars", View(index, index + 1), alphabet)


def prefix(text: str) -> Test:
    return Test("prefix", text=text)


def check(reason: str, key: str, *alternatives: Test | Sequence[Test]) -> Check:
    return Check(tuple((a,) if isinstance(a, Test) else tuple(a) for a in alternatives), reason, key)


def plain(key: str, lengths: Sequence[tuple[int, int]] | int, alphabet: str = DIGITS, *more: Check) -> tuple[Check, ...]:
    """Not empty, of a length, of characters, and more."""
    spans = [(lengths, lengths)] if isinstance(lengths, int) else lengths
    fits = length(*spans[0]) if len(spans) == 1 else Test("lengths", text="".join(f"/{n}" for a, b in spans for n in range(a, b + 1)) + "/")
    return (
        check("empty", f"{key}.empty", ~empty()),
        check("invalid_length", f"{key}.length", fits),
        check("invalid_characters", f"{key}.characters", chars(alphabet)),
        *more,
    )


def weighted(weights: Sequence[int], modulus: int, view: View = View(), **how) -> Sum:
    return Sum("weighted", view, tuple(weights), modulus=modulus, **how)


def digit(sum_: Sum, index: int, table: Sequence[int]) -> Sum:
    """The sum's remainder, by table, must be the digit at index; -1 is the last one."""
    return replace(sum_, table=tuple(table), against="digits", digits=View(index, index + 1 or None))


def one(sum_: Sum) -> Checksum:
    return ((Branch((sum_,)),),)


def second_try(first: Sum, second: Sum, judged_first: Sum) -> tuple[Branch, ...]:
    """second where first's remainder is 10, else judged_first."""
    return (Branch((second,), sums=(replace(first, table=None, against="constant", constant=10),)), Branch((judged_first,)))


def on(outer: View, checksum: Checksum) -> Checksum:
    return tuple(tuple(b.on(outer) for b in part) for part in checksum)


__all__ = ["BASE36", "BASES", "DIGITS", "Branch", "Canonical", "Check", "Checksum", "Definition", "Sum", "Test", "View", "at", "chars", "check", "digit", "empty", "length", "on", "one", "plain", "prefix", "second_try", "weighted"]
