"""One expression that evaluates any rule row: its checks, sums and checksums.

The checks most rules begin with are plain columns and run as generated code. Other checks and
all checksums are nested lists that go through lambdas, in one step: a chain of projections
would be copied from stage to stage, or become one method too large for the JIT. Columns
read here are those that engine.py names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpident.operators import integers, outcomes
from corpident.operators.alphabets import BASE36, DIGITS
from corpident.operators.columns import luhn_check
from corpident.plans.tables import HEAD

OUTCOME = outcomes.TYPE
#: Digits of one number, at most.
MOST_DIGITS = 18
BASE_COLUMNS = ("e_canonical", "e_register", "e_tail")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def register(s: Column, country: Column) -> Column:
    """What stands between a EUID's country and its first full stop; NULL if there is none."""
    after = F.when(F.instr(s, country) > 0, F.substring(s, F.instr(s, country) + F.length(country), F.length(s)))
    dot = F.instr(after, F.lit("."))
    return F.when(dot > 0, F.substring(after, F.lit(1), dot - 1))


def tail(s: Column) -> Column:
    dot = F.instr(s, F.lit("."))
    return F.when(dot > 0, F.substring(s, dot + 1, F.length(s)))


def view(base: Column, start: Column, stop: Column) -> Column:
    """A part of a base; NULL if the base is absent or too short."""
    s = F.when(base == 0, F.col(BASE_COLUMNS[0])).when(base == 1, F.col(BASE_COLUMNS[1])).otherwise(F.col(BASE_COLUMNS[2]))
    n = F.length(s)
    end = F.when(stop.isNull(), n).when(stop < 0, n + stop).otherwise(stop)
    first = F.when(start < 0, n + start).otherwise(start)
    part = F.when((first >= 0) & (first <= end) & (end <= n), F.substring(s, first + 1, end - first))
    return F.when((start == 0) & stop.isNull(), s).otherwise(part)


def test(t: Column) -> Column:
    """A test of a rule. NULL where a register list is needed and missing, else firm."""

    def on(v: Column) -> Column:
        op = t["op"]
        plain = (
            F.when(op == "chars", integers.consists_of(v, t["text"]))
            .when(op == "length", F.length(v).between(t["least"], t["most"]))
            .when(op == "empty", v == "")
            .when(op == "lengths", _among(F.length(v), t["text"]))
            .when(op == "prefix", F.startswith(v, t["text"]))
            .when(op == "contains", F.contains(v, t["text"]))
            .when(op == "absent", v.isNull())
            .when(op == "profile", F.col("e_profile") == t["text"])
        )
        return F.when(op == "listed", F.col("e_listed")).otherwise(F.coalesce(plain, F.lit(False))) != t["negated"]

    return let(view(t["base"], t["start"], t["stop"]), on)


def _among(n: Column, lengths: Column) -> Column:
    return F.contains(lengths, F.concat(F.lit("/"), n.cast("string"), F.lit("/")))


def head_failure() -> Column:
    """The name of the first check in HEAD that fails, or NULL."""
    col, s = F.col, F.col("e_canonical")
    body = F.when(col("r_from") == 0, s).when(F.length(s) >= col("r_from"), F.substring(s, col("r_from") + 1, F.length(s)))
    fits = F.exists("r_spans", lambda x: F.length(s).between(x["least"], x["most"]))
    return (
        F.when(col("r_empty").isNotNull() & (s == ""), "empty")
        .when(col("r_length").isNotNull() & ~fits, "length")
        .when(col("r_start").isNotNull() & ~F.startswith(s, col("r_starts")), "prefix")
        .when(col("r_chars").isNotNull() & ~integers.consists_of(body, col("r_alphabet")), "chars")
    )


def rest_failure() -> Column:
    """The first check of l_rest that fails, as a struct (reason_code, message_key, known); NULL
    if none does. known is false where a register list is missing, so that nothing is proven."""

    def judged(c: Column) -> Column:
        return F.struct(c["reason"].alias("reason_code"), c["key"].alias("message_key"), F.exists(c["alternatives"], lambda a: F.forall(a, lambda t: test(t))).alias("holds"))

    failed = F.get(F.filter(F.transform("l_rest", judged), lambda c: ~F.coalesce(c["holds"], F.lit(False))), F.lit(0))
    return let(failed, lambda c: F.when(c["reason_code"].isNotNull(), F.struct(c["reason_code"].alias("reason_code"), c["message_key"].alias("message_key"), c["holds"].isNotNull().alias("known"))))


def head_reason() -> Column:
    return _by_head({op: F.lit(reason) for op, reason in HEAD.items()})


def head_key() -> Column:
    return _by_head(dict(zip(HEAD, map(F.col, ("r_empty", "r_length", "r_start", "r_chars")))))


def _by_head(what: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for op, c in what.items():
        out = F.when(F.col("e_head") == op, c).otherwise(out)
    return out


def _finished(r: Column, s: Column) -> Column:
    r = F.when(s["complement"], integers.complement(r, s["modulus"])).otherwise(r)
    return F.when(s["remainders"].isNull(), r).otherwise(integers.remainder_map(r, s["remainders"]))


def _result(known: Column, holds: Column, key: Column) -> Column:
    status = F.when(~F.coalesce(known, F.lit(False)), "unsupported").when(holds, "valid").otherwise("invalid")
    reason = F.when(status == "valid", "ok").when(status == "invalid", "invalid_checksum").otherwise("unsupported_checksum")
    return F.struct(status.alias("status"), reason.alias("reason_code"), F.when(status == "invalid", key).alias("message_key"))


def _expected(s: Column) -> Column:
    return F.when(s["against"] == "digits", integers.digits_to_integer(view(s["d_base"], s["d_start"], s["d_stop"]))).otherwise(s["constant"])


def outcome(s: Column) -> Column:
    """valid, invalid or unsupported, with reason and key, for one sum of several."""

    def places(v: Column) -> Column:
        """A weighted sum of digits as places of one number."""
        read = F.when(integers.consists_of(v, DIGITS) & (F.length(v) <= MOST_DIGITS), v.try_cast("bigint"))
        return let(read, lambda n: F.aggregate(s["terms"], F.lit(0).cast("bigint"), lambda total, t: total + F.call_function("div", n, t["power"]) % 10 * t["weight"]))

    def number(v: Column) -> Column:
        total = F.when(s["terms"].isNotNull(), places(v)).otherwise(integers.weighted_sum(v, s["weights"], s["alignment"], s["alphabet"]))
        raw = F.when(s["kind"] == "weighted", F.pmod(total, s["modulus"])).otherwise(integers.mod_digits(v, s["modulus"]))
        return let(raw, lambda r: _finished(r, s))

    def luhn(v: Column) -> Column:
        return _result((F.length(v) >= 2) & integers.consists_of(v, DIGITS), luhn_check(v), s["key"])

    def mod97(v: Column) -> Column:
        return _result((F.length(v) >= 3) & integers.consists_of(v, BASE36), outcomes.mod97_remainder(v) == 1, s["key"])

    own = view(s["base"], s["start"], s["stop"])
    compared = let(F.struct(let(own, number).alias("i"), _expected(s).alias("e")), lambda p: _result(p["i"].isNotNull() & p["e"].isNotNull(), p["i"] == p["e"], s["key"]))
    none = F.struct(F.lit("unsupported").alias("status"), s["reason"].alias("reason_code"), s["key"].alias("message_key"))
    return F.when(s["kind"] == "unsupported", none).when(s["kind"] == "luhn", let(own, luhn)).when(s["kind"] == "mod97", let(own, mod97)).otherwise(compared)


def _first_of(found: Column, order: tuple[str, ...], otherwise: Column) -> Column:
    def first(status: str) -> Column:
        return F.get(F.filter(found, lambda o: o["status"] == status), F.lit(0))

    return F.coalesce(*[first(status) for status in order], otherwise)


def outcome_of_parts() -> Column:
    """The outcome of l_parts: all must pass; in a part, the first branch that applies decides."""

    def applies(b: Column) -> Column:
        tests = F.forall(b["tests"], lambda t: F.coalesce(test(t), F.lit(False)))
        return tests & F.forall(b["sums"], lambda s: outcome(s)["status"] == "valid")

    def part(branches: Column) -> Column:
        chosen = F.get(F.filter(branches, applies), F.lit(0))
        found = let(chosen, lambda b: _first_of(F.transform(b["any_of"], lambda s: outcome(s)), ("valid", "unsupported", "invalid"), outcomes.unsupported().cast(OUTCOME)))
        return F.coalesce(found, outcomes.unsupported().cast(OUTCOME))

    return let(F.transform("l_parts", part), lambda found: _first_of(found, ("invalid", "unsupported"), outcomes.valid().cast(OUTCOME)))


def checksum() -> Column:
    """The outcome of l_sum, or else of l_parts."""
    return F.when(F.col("l_sum").isNotNull(), let(F.col("l_sum"), lambda s: outcome(s))).otherwise(outcome_of_parts())
