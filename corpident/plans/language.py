"""The rule language: a program is a list of typed nodes, each reading earlier ones.

A node is {"op": name, "in": [indices], parameters}. compile_program() turns a program into a
function that builds columns; every operator is one line of OPS. Bundles of programs come
from JSON and pass plans.checks before anything is compiled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpident.operators import assertions, canonical, integers, outcomes, predicates, strings
from corpident.operators.alphabets import BASE36, DIGITS

STRING, INTEGER, BOOLEAN, STEP, ASSERTION, OUTCOME = "string", "integer", "boolean", "step", "assertion", "outcome"
MANY = 4096


@dataclass
class Context:
    """What a program reads: the canonical value (in steps: the value so far), the caller's
    argument if it is called, the target's country, prefixes and canonical prefix, the profile."""

    value: Column
    argument: Column | None = None
    subject: Column | None = None
    country: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    prefixes: tuple[str, ...] = ()
    prefix: str = ""
    profile: Column = field(default_factory=lambda: F.lit("compatible"))


@dataclass(frozen=True)
class Op:
    """operands: fixed types, then one that may repeat between least and most times."""

    output: str
    build: Callable[..., Any]
    operands: tuple[str, ...] = ()
    repeated: str | None = None
    least: int = 0
    most: int = MANY
    params: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    capabilities: tuple[int, ...] = (1,)


def _sum(s: Column, node: dict) -> Column:
    alphabet = {"digit_value": DIGITS, "alnum_base36": BASE36}.get(node["mapping"], node.get("alphabet"))
    return integers.weighted_sum(s, node["weights"], node["alignment"], alphabet)


_S, _I, _B = (STRING,), (INTEGER,), (BOOLEAN,)
_T = ("text",)
_K = ("message_key",)

#: name: builder of (context, node, operands). Calls get the bundle's compiled programs by compile_program.
OPS: dict[str, Op] = {
    # views
    "string_constant": Op(STRING, lambda c, n: strings.constant(n["text"]), params=_T),
    "string_value": Op(STRING, lambda c, n: strings.value(c.value)),
    "string_subject": Op(STRING, lambda c, n: strings.subject(c.argument, c.subject, c.value)),
    "string_country_code": Op(STRING, lambda c, n: strings.country_code(c.country), capabilities=(1, 5)),
    "string_slice": Op(STRING, lambda c, n, s: strings.slice_(s, n["start"], n["end"]), _S, params=("start", "end"), capabilities=(1, 10)),
    "string_slice_from": Op(STRING, lambda c, n, s: strings.slice_from(s, n["start"]), _S, params=("start",), capabilities=(1, 10)),
    "string_slice_to": Op(STRING, lambda c, n, s: strings.slice_to(s, n["end"]), _S, params=("end",), capabilities=(1, 10)),
    "string_before_first": Op(STRING, lambda c, n, s: strings.before_first(s, n["text"]), _S, params=_T, capabilities=(1, 10)),
    "string_after_first": Op(STRING, lambda c, n, s: strings.after_first(s, n["text"]), _S, params=_T, capabilities=(1, 10)),
    "string_strip_prefix": Op(STRING, lambda c, n, s: strings.strip_prefix(s, n["text"]), _S, params=_T, capabilities=(1, 10)),
    "string_concat": Op(STRING, lambda c, n, *s: strings.concat(*s), (), STRING, 1, 256, capabilities=(1, 10)),
    # integers
    "integer_digits_to_integer": Op(INTEGER, lambda c, n, s: integers.digits_to_integer(s), _S, capabilities=(1, 30)),
    "integer_mod_digits": Op(INTEGER, lambda c, n, s: integers.mod_digits(s, n["modulus"]), _S, params=("modulus",), capabilities=(1, 30)),
    "integer_weighted_sum": Op(INTEGER, lambda c, n, s: _sum(s, n), _S, params=("weights", "alignment", "mapping"), optional=("alphabet",), capabilities=(1, 30, 33)),
    "integer_modulo": Op(INTEGER, lambda c, n, i: integers.modulo(i, n["modulus"]), _I, params=("modulus",), capabilities=(1, 30)),
    "integer_complement": Op(INTEGER, lambda c, n, i: integers.complement(i, n["modulus"]), _I, params=("modulus",), capabilities=(1, 30)),
    "integer_remainder_map": Op(INTEGER, lambda c, n, i: integers.remainder_map(i, n["values"]), _I, params=("values",), capabilities=(1, 30)),
    # predicates
    "predicate_is_empty": Op(BOOLEAN, lambda c, n, s: predicates.is_empty(s), _S, capabilities=(1, 20)),
    "predicate_is_absent": Op(BOOLEAN, lambda c, n, s: predicates.is_absent(s), _S, capabilities=(1, 10)),
    "predicate_equals": Op(BOOLEAN, lambda c, n, a, b: predicates.equals(a, b), (STRING, STRING), capabilities=(1, 20)),
    "predicate_length_eq": Op(BOOLEAN, lambda c, n, s: predicates.length_eq(s, n["length"]), _S, params=("length",), capabilities=(1, 20)),
    "predicate_length_in": Op(BOOLEAN, lambda c, n, s: predicates.length_in(s, n["lengths"]), _S, params=("lengths",), capabilities=(1, 20)),
    "predicate_length_between": Op(BOOLEAN, lambda c, n, s: predicates.length_between(s, n["min"], n["max"]), _S, params=("min", "max"), capabilities=(1, 20)),
    "predicate_ascii_digits": Op(BOOLEAN, lambda c, n, s: predicates.ascii_digits(s), _S, capabilities=(1, 2)),
    "predicate_ascii_upper_letters": Op(BOOLEAN, lambda c, n, s: predicates.ascii_upper_letters(s), _S, capabilities=(1, 2)),
    "predicate_ascii_alphanumeric": Op(BOOLEAN, lambda c, n, s: predicates.ascii_alphanumeric(s), _S, capabilities=(1, 2)),
    "predicate_ascii_charset": Op(BOOLEAN, lambda c, n, s: predicates.ascii_charset(s, n["chars"]), _S, params=("chars",), capabilities=(1, 2)),
    "predicate_starts_with": Op(BOOLEAN, lambda c, n, s: predicates.starts_with(s, n["text"]), _S, params=_T, capabilities=(1, 20)),
    "predicate_ends_with": Op(BOOLEAN, lambda c, n, s: predicates.ends_with(s, n["text"]), _S, params=_T, capabilities=(1, 20)),
    "predicate_prefix_in": Op(BOOLEAN, lambda c, n, s: predicates.prefix_in(s, n["texts"]), _S, params=("texts",), capabilities=(1, 20)),
    "predicate_char_at_in": Op(BOOLEAN, lambda c, n, s: predicates.char_at_in(s, n["index"], n["chars"]), _S, params=("index", "chars"), capabilities=(1, 20)),
    "predicate_contains": Op(BOOLEAN, lambda c, n, s: predicates.contains(s, n["text"]), _S, params=_T, capabilities=(1, 20)),
    "predicate_all": Op(BOOLEAN, lambda c, n, *b: predicates.all_of(*b), (), BOOLEAN, 1, capabilities=(1, 20)),
    "predicate_any": Op(BOOLEAN, lambda c, n, *b: predicates.any_of(*b), (), BOOLEAN, 1, capabilities=(1, 20)),
    "predicate_not": Op(BOOLEAN, lambda c, n, b: predicates.not_(b), _B, capabilities=(1, 20)),
    "predicate_profile_is": Op(BOOLEAN, lambda c, n: predicates.profile_is(c.profile, n["profile"]), params=("profile",), capabilities=(1, 21)),
    "predicate_integer_is": Op(BOOLEAN, lambda c, n, i: predicates.integer_is(i, n["constant"]), _I, params=("constant",), capabilities=(1, 30, 35)),
    # canonicalization steps; their operands are functions of the value so far
    "canonicalization_sequence": Op(STEP, lambda c, n, *s: canonical.steps(*s), (), STEP, 0, capabilities=(1, 3)),
    "canonicalization_trim_whitespace": Op(STEP, lambda c, n: canonical.trim_whitespace(), capabilities=(1, 2, 3)),
    "canonicalization_remove_whitespace": Op(STEP, lambda c, n: canonical.remove_whitespace(), capabilities=(1, 2, 3)),
    "canonicalization_uppercase_ascii": Op(STEP, lambda c, n: canonical.uppercase_ascii(), capabilities=(1, 2, 3)),
    "canonicalization_remove_chars": Op(STEP, lambda c, n: canonical.remove_chars(n["chars"]), params=("chars",), capabilities=(1, 3)),
    "canonicalization_replace_prefix": Op(STEP, lambda c, n: canonical.replace_prefix(n["text"], n["replacement"]), params=("text", "replacement"), capabilities=(1, 3)),
    "canonicalization_prepend": Op(STEP, lambda c, n: canonical.prepend(n["text"]), params=_T, capabilities=(1, 3)),
    "canonicalization_append": Op(STEP, lambda c, n: canonical.append(n["text"]), params=_T, capabilities=(1, 3)),
    "canonicalization_insert": Op(STEP, lambda c, n: canonical.insert(n["index"], n["text"]), params=("index", "text"), capabilities=(1, 3)),
    "canonicalization_left_pad": Op(STEP, lambda c, n: canonical.left_pad(n["length"], n["pad"]), params=("length", "pad"), capabilities=(1, 3)),
    "canonicalization_prepend_country_if_missing": Op(STEP, lambda c, n: canonical.prepend_country_if_missing(c.prefixes, c.prefix), capabilities=(1, 3, 5)),
    "canonicalization_when": Op(STEP, lambda c, n, p, *s: canonical.when(p, *s), _B, STEP, 1, capabilities=(1, 4)),
    # assertions
    "assertion_sequence": Op(ASSERTION, lambda c, n, *a: assertions.sequence(*a), (), ASSERTION, 1, capabilities=(1, 20)),
    "assertion_require": Op(ASSERTION, lambda c, n, b: assertions.require(b, n["reason_code"], n.get("message_key")), _B, params=("reason_code",), optional=_K, capabilities=(1, 20)),
    # checksum outcomes
    "checksum_luhn": Op(OUTCOME, lambda c, n, s: outcomes.luhn(s, n.get("message_key")), _S, optional=_K, capabilities=(1, 30, 31)),
    "checksum_iso7064_mod97_10": Op(OUTCOME, lambda c, n, s: outcomes.mod97_10(s, n.get("message_key")), _S, optional=_K, capabilities=(1, 30, 32)),
    "checksum_compare_digit": Op(OUTCOME, lambda c, n, i, s: outcomes.compare_digit(i, s, n["index"], n.get("message_key")), (INTEGER, STRING), params=("index",), optional=_K, capabilities=(1, 30)),
    "checksum_compare_slice": Op(OUTCOME, lambda c, n, i, s: outcomes.compare_slice(i, s, n["start"], n["end"], n.get("message_key")), (INTEGER, STRING), params=("start", "end"), optional=_K, capabilities=(1, 30)),
    "checksum_choose": Op(OUTCOME, lambda c, n, *o: outcomes.choose(*o), (), OUTCOME, 1, capabilities=(1, 30)),
    "checksum_when": Op(OUTCOME, lambda c, n, b, o: outcomes.when(b, o), (BOOLEAN, OUTCOME), capabilities=(1, 30)),
    "checksum_all_checks": Op(OUTCOME, lambda c, n, *o: outcomes.all_checks(*o), (), OUTCOME, 1, capabilities=(1, 30)),
    "checksum_any_check": Op(OUTCOME, lambda c, n, *o: outcomes.any_check(*o), (), OUTCOME, 1, capabilities=(1, 30)),
    "checksum_unsupported": Op(OUTCOME, lambda c, n: outcomes.unsupported(n["reason_code"], n.get("message_key")), params=("reason_code",), optional=_K, capabilities=(1, 30)),
    "checksum_compare_constant": Op(OUTCOME, lambda c, n, i: outcomes.compare_constant(i, n["constant"], n.get("message_key")), _I, params=("constant",), optional=_K, capabilities=(1, 30, 34)),
    # calls
    "call_format": Op(ASSERTION, lambda c, n, s: None, _S, params=("program",), capabilities=(1, 11, 20)),
    "call_checksum": Op(OUTCOME, lambda c, n, s: None, _S, params=("program",), capabilities=(1, 11, 30)),
}

#: The type of a program's root.
ROOTS = {"canonicalization": STEP, "pre_canonicalization": STEP, "format": ASSERTION, "checksum": OUTCOME}


def compile_program(program: dict, programs: dict[int, dict]) -> Callable[[Context], Any]:
    """A function of a context to the root's column, or for canonicalizations to a step."""
    nodes = program["nodes"]

    def node(i: int, c: Context) -> Any:
        n = nodes[i]
        op = OPS[n["op"]]
        if op.output == STEP and n["op"] == "canonicalization_when":
            # the condition reads the value at that step
            test, *then = n["in"]
            return canonical.when(lambda v: node(test, Context(v, c.argument, None, c.country, c.prefixes, c.prefix, c.profile)), *[node(j, c) for j in then])
        operands = [node(j, c) for j in n.get("in", [])]
        if n["op"] in ("call_format", "call_checksum"):
            return compile_program(programs[n["program"]], programs)(Context(c.value, operands[0], None, c.country, c.prefixes, c.prefix, c.profile))
        return op.build(c, n, *operands)

    def run(c: Context) -> Any:
        if program.get("subject") is not None and c.argument is None:
            c = Context(c.value, None, node(program["subject"], c), c.country, c.prefixes, c.prefix, c.profile)
        return node(program["root"], c)

    return run
