"""The 25 checks a rule bundle passes before it runs, in their stated order.

A bundle is a JSON object: format_version, required_feature_ids, rules_version, source_digest
(hex), programs, definitions, dispatchers. The first violation is raised: IncompatibleRuleset
for an unknown format version or capability, InvalidRuleset for all else. Limits are fixed
values.
"""

from __future__ import annotations

import json
import re
from typing import Any

from corpident.operators.assertions import PROVING

from .catalog import CAPABILITIES, PROFILES
from .language import OPS, ROOTS

MAX_BUNDLE, MAX_PROGRAM_NODES, MAX_NODES, MAX_DEFINITIONS = 16 * 1024 * 1024, 4096, 500_000, 10_000
MAX_TEXT, MAX_INDEX, MAX_DEPTH, BUDGET, MAX_CAPTURES = 4096, 4096, 32, 100_000, 128
MODULI, WEIGHT, WEIGHTS, REMAINDERS, CONSTANT, ALPHABET = (2, 10**9), 10**6, 256, 10**6, 10**9, 256
#: Code points that a view may hold as far as can be proven.
CEILING = 1 << 20
UNSUPPORTED_REASONS = ("unsupported_format", "unsupported_checksum", "checksum_not_published")
PRE_STEPS = {"canonicalization_sequence", "canonicalization_trim_whitespace", "canonicalization_remove_whitespace", "canonicalization_uppercase_ascii", "canonicalization_remove_chars"}
FIELDS = {
    "bundle": {"format_version", "required_feature_ids", "rules_version", "source_digest", "programs", "definitions", "dispatchers"},
    "program": {"id", "kind", "nodes", "root", "subject", "captures"},
    "capture": {"name", "node"},
    "definition": {"id", "kind", "country", "canonicalization", "format", "checksum", "absence", "default_profile", "sources"},
    "dispatcher": {"kind", "aliases", "pre_canonicalization", "country_aliases", "targets"},
    "target": {"country", "definition", "prefixes", "canonical_prefix"},
}


class InvalidRuleset(ValueError):
    code = "invalid_ruleset"


class IncompatibleRuleset(ValueError):
    code = "incompatible_ruleset"


def _need(condition: Any, why: str, number: int) -> None:
    if not condition:
        raise InvalidRuleset(f"check {number}: {why}")


def _ascending(values: list, strictly: bool = True) -> bool:
    return all(a < b if strictly else a <= b for a, b in zip(values, values[1:]))


def load(data: bytes) -> dict:
    """The bundle, once all checks hold. InvalidRuleset or IncompatibleRuleset is all it
    raises: a value of the wrong type fails the check that first has to read it."""
    _need(len(data) <= MAX_BUNDLE, "the bundle is too large", 1)
    try:
        bundle = json.loads(data)
    except (ValueError, RecursionError) as e:
        raise InvalidRuleset(f"check 2: {e}") from e
    _need(isinstance(bundle, dict), "not an object", 2)
    if bundle.get("format_version") != 1 or isinstance(bundle["format_version"], bool):
        raise IncompatibleRuleset("check 3: unknown format version")
    features = bundle.get("required_feature_ids", [])
    _need(isinstance(features, list) and all(type(f) is int for f in features), "capabilities are not numbers", 4)
    if not set(features) <= set(CAPABILITIES):
        raise IncompatibleRuleset("check 4: unknown capability")
    _need(_ascending(features), "capabilities are not ascending", 4)
    _unknown_fields(bundle)
    _need(_matches(r"[A-Za-z0-9._-]{1,64}", bundle.get("rules_version")), "rules_version", 6)
    _need(_matches(r"[0-9a-f]{64}", bundle.get("source_digest")), "source_digest is not 32 bytes", 7)
    programs = bundle.get("programs", [])
    ids = [p.get("id") for p in programs]
    _need(all(type(i) is int for i in ids) and _ascending([0, *ids]), "program ids are not ascending from 1", 8)
    _need(all(isinstance(p.get("kind"), str) and p["kind"] in ROOTS for p in programs), "a program's kind is not stated", 8)
    _need(all(_objects(p.get("nodes")) for p in programs), "a program's nodes are not stated", 9)
    _need(all(len(p["nodes"]) <= MAX_PROGRAM_NODES for p in programs) and sum(len(p["nodes"]) for p in programs) <= MAX_NODES, "too many nodes", 9)
    by_id = dict(zip(ids, programs))
    at = 10
    try:
        for p in programs:
            for i, n in enumerate(p["nodes"]):
                _node(p, i, n)
            _widths(p)
        at = 14
        for p in programs:
            _need(_instances(p) <= BUDGET, f"program {p['id']} expands too far", 14)
        at = 15
        for p in programs:
            _roots(p)
        at = 16
        for p in programs:
            _shape(p)
        at = 17
        definitions = bundle.get("definitions", [])
        _definitions(definitions, by_id)
        at = 19
        _dispatchers(bundle.get("dispatchers", []), definitions, by_id)
        at = 24
        _calls(by_id)
    except (TypeError, KeyError, AttributeError, IndexError, OverflowError, RecursionError) as e:
        # a field of the wrong type, or none where one is due
        raise InvalidRuleset(f"check {at}: malformed: {e!r}") from e
    used = set().union(*[OPS[n["op"]].capabilities for p in programs for n in p["nodes"]])
    used |= {42 for p in programs for n in p["nodes"] if n.get("mapping") == "custom_alphabet"}
    used |= {11 for p in programs if p.get("captures")}
    _need(used <= set(features), f"capabilities {sorted(used - set(features))} are used but not declared", 25)
    return bundle


def _matches(pattern: str, value: Any) -> bool:
    return isinstance(value, str) and re.fullmatch(pattern, value) is not None


def _objects(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(x, dict) for x in value)


def _unknown_fields(bundle: dict) -> None:
    def known(kind: str, item: dict) -> None:
        _need(isinstance(item, dict) and set(item) <= FIELDS[kind], f"unknown field in a {kind}", 5)

    def each(kind: str, items: Any) -> list:
        _need(_objects(items), f"{kind}s are not a list of objects", 5)
        for item in items:
            known(kind, item)
        return items

    known("bundle", bundle)
    for p in each("program", bundle.get("programs", [])):
        each("capture", [] if p.get("captures") is None else p["captures"])
    each("definition", bundle.get("definitions", []))
    for d in each("dispatcher", bundle.get("dispatchers", [])):
        each("target", d.get("targets", []))


def _node(p: dict, i: int, n: dict) -> None:
    where = f"program {p['id']} node {i}"
    op = OPS.get(n["op"]) if isinstance(n.get("op"), str) else None
    _need(op, f"{where}: unknown operation", 10)
    operands, fixed = n.get("in", []), len(op.operands)
    rest = len(operands) - fixed
    _need(rest >= 0 and (op.least <= rest <= op.most if op.repeated else rest == 0), f"{where}: number of operands", 11)
    for k, j in enumerate(operands):
        _need(isinstance(j, int) and 0 <= j < i, f"{where}: operand {j} is not an earlier node", 11)
        wanted = op.operands[k] if k < fixed else op.repeated
        _need(OPS[p["nodes"][j]["op"]].output == wanted, f"{where}: operand {j} is no {wanted}", 11)
    given = set(n) - {"op", "in"}
    _need(set(op.params) <= given <= set(op.params) | set(op.optional), f"{where}: parameters {sorted(given)}", 12)
    _bounds(where, n)


def _bounds(where: str, n: dict) -> None:
    def need(condition: Any, why: str) -> None:
        _need(condition, f"{where}: {why}", 13)

    op = n["op"]
    for name in ("text", "replacement", "chars", "pad", "message_key", "alphabet"):
        if name in n:
            need(isinstance(n[name], str) and len(n[name].encode()) <= MAX_TEXT, f"{name} is too long")
            need(n[name] or name == "replacement" or op == "string_constant", f"{name} is empty")
    if op == "predicate_ascii_charset":
        need(n["chars"].isascii(), "chars beyond ASCII")
    if "pad" in n:
        need(len(n["pad"]) == 1, "pad is not one character")
    for name in ("start", "end", "index", "length", "min", "max"):
        if name in n:
            need(isinstance(n[name], int) and 0 <= n[name] <= MAX_INDEX, f"{name} is out of range")
    if {"start", "end"} <= set(n):
        need(n["start"] <= n["end"], "start is beyond end")
        need(op != "checksum_compare_slice" or 1 <= n["end"] - n["start"] <= 18, "the slice is not 1 to 18 wide")
    if "min" in n:
        need(n["min"] <= n["max"], "min is beyond max")
    if "modulus" in n:
        need(MODULI[0] <= n["modulus"] <= MODULI[1], "modulus")
    if "constant" in n:
        need(abs(n["constant"]) <= CONSTANT, "constant")
    if "values" in n:
        need(1 <= len(n["values"]) <= REMAINDERS and all(abs(v) <= CONSTANT for v in n["values"]), "values")
    if "lengths" in n:
        need(n["lengths"] and _ascending(n["lengths"]) and 0 <= n["lengths"][0] and n["lengths"][-1] <= MAX_INDEX, "lengths")
    if "texts" in n:
        need(n["texts"] and all(n["texts"]) and _ascending([t.encode() for t in n["texts"]]), "texts are not sorted and distinct")
        need(len({len(t.encode()) for t in n["texts"]}) == 1, "texts differ in length")
    if "weights" in n:
        need(1 <= len(n["weights"]) <= WEIGHTS and all(abs(w) <= WEIGHT for w in n["weights"]), "weights")
        need(n["alignment"] in ("left", "right", "cycle"), "alignment")
        need(n["mapping"] in ("digit_value", "alnum_base36", "custom_alphabet"), "mapping")
        custom = n.get("alphabet")
        need((n["mapping"] == "custom_alphabet") == (custom is not None), "alphabet")
        need(custom is None or (len(custom) <= ALPHABET and len(set(custom)) == len(custom)), "alphabet")
    if "profile" in n:
        need(n["profile"] in PROFILES, "profile")
    if "reason_code" in n:
        need(n["reason_code"] in (PROVING if op == "assertion_require" else UNSUPPORTED_REASONS), "reason_code")


def _widths(p: dict) -> None:
    """Numbers must fit: what is read as one has 1 to 18 digits, and no sum can overflow."""
    widths = []
    for i, n in enumerate(p["nodes"]):
        own = [widths[j] for j in n.get("in", [])]
        op, first = n["op"], own[0] if own else CEILING
        width = CEILING
        if op == "string_constant":
            width = len(n["text"])
        elif op == "string_country_code":
            width = 2
        elif op == "string_slice":
            width = n["end"] - n["start"]
        elif op == "string_slice_from":
            width = max(0, first - n["start"])
        elif op == "string_slice_to":
            width = min(n["end"], first)
        elif op in ("string_before_first", "string_after_first", "string_strip_prefix"):
            width = first
        elif op == "string_concat":
            width = sum(own)
        elif op == "integer_digits_to_integer":
            _need(1 <= first <= 18, f"program {p['id']} node {i}: up to {first} digits", 13)
        elif op == "integer_weighted_sum":
            places = first if n["alignment"] == "cycle" else min(first, len(n["weights"]))
            largest = {"digit_value": 9, "alnum_base36": 35}.get(n["mapping"], len(n.get("alphabet") or " ") - 1)
            _need(largest * max(map(abs, n["weights"])) * places < 1 << 63, f"program {p['id']} node {i}: the sum may overflow", 13)
        widths.append(min(width, CEILING))


def _instances(p: dict) -> int:
    """Operations once shared operands are written out: of the root, the subject, and captures neither reaches."""
    costs: list[int] = []
    for n in p["nodes"]:
        costs.append(min(1 + sum(costs[j] for j in n.get("in", [])), BUDGET + 1))
    n = len(costs)
    starts = [p.get("root"), p.get("subject"), *sorted((c["node"] for c in p.get("captures") or []), reverse=True)]
    reached: set[int] = set()
    total = 0
    for start in starts:
        if not isinstance(start, int) or not 0 <= start < n or start in reached:
            continue
        total += costs[start]
        todo = [start]
        while todo:
            i = todo.pop()
            if i not in reached:
                reached.add(i)
                todo += p["nodes"][i].get("in", [])
    return total


def _roots(p: dict) -> None:
    def typed(i: Any, kind: str | None = None) -> bool:
        return isinstance(i, int) and 0 <= i < len(p["nodes"]) and (kind is None or OPS[p["nodes"][i]["op"]].output == kind)

    where = f"program {p['id']}"
    _need(typed(p.get("root")), f"{where}: root", 15)
    if (subject := p.get("subject")) is not None:
        _need(typed(subject, "string"), f"{where}: subject", 15)
        todo = [subject]
        while todo:
            n = p["nodes"][todo.pop()]
            _need(n["op"] != "string_subject", f"{where}: the subject reads itself", 15)
            todo += n.get("in", [])
    captures = p.get("captures") or []
    _need(len(captures) <= MAX_CAPTURES and len({c["name"] for c in captures}) == len(captures) and all(typed(c["node"], "string") for c in captures), f"{where}: captures", 15)


def _shape(p: dict) -> None:
    where, kind = f"program {p['id']}", p["kind"]
    _need(OPS[p["nodes"][p["root"]]["op"]].output == ROOTS[kind], f"{where}: the root is no {ROOTS[kind]}", 16)
    outputs = {OPS[n["op"]].output for n in p["nodes"]}
    allowed = {"canonicalization": {"step", "string", "boolean"}, "pre_canonicalization": {"step"}, "format": {"assertion", "string", "boolean"}, "checksum": {"outcome", "integer", "string", "boolean"}}[kind]
    _need(outputs <= allowed, f"{where}: operations of another kind of program", 16)
    if kind == "pre_canonicalization":
        _need({n["op"] for n in p["nodes"]} <= PRE_STEPS, f"{where}: steps beyond the five", 16)
    for i, n in enumerate(p["nodes"]):
        if n["op"] == "checksum_when":
            _need(p["root"] != i and all(m["op"] == "checksum_choose" for m in p["nodes"] if i in m.get("in", [])), f"{where}: a branch outside choose", 16)


def _definitions(definitions: list[dict], programs: dict[int, dict]) -> None:
    ids = [d.get("id", "") for d in definitions]
    _need(len(ids) <= MAX_DEFINITIONS and _ascending(ids), "definition ids", 17)
    for d in definitions:
        _need(re.fullmatch(r"[a-z][a-z0-9_]{0,63}", d.get("kind", "")) and re.fullmatch(r"[A-Z]{2}|GLOBAL", d.get("country", "")), f"{d.get('id')}: kind or country", 17)
        _need(d.get("default_profile") in PROFILES, f"{d['id']}: profile", 17)
        _need(d.get("sources"), f"{d['id']}: no source", 17)
        for name in ("canonicalization", "format"):
            _need(programs.get(d.get(name), {}).get("kind") == name, f"{d['id']}: {name}", 17)
        _need(("checksum" in d) != ("absence" in d), f"{d['id']}: a checksum or a reason for none", 18)
        if "checksum" in d:
            _need(programs.get(d["checksum"], {}).get("kind") == "checksum", f"{d['id']}: checksum", 18)
        else:
            _need(d["absence"] in UNSUPPORTED_REASONS[1:], f"{d['id']}: absence", 18)


def _dispatchers(dispatchers: list[dict], definitions: list[dict], programs: dict[int, dict]) -> None:
    by_id, referenced = {d["id"]: d for d in definitions}, []
    tokens = [t for d in dispatchers for t in (d["kind"], *d.get("aliases", []))]
    _need(_ascending([d["kind"] for d in dispatchers]) and all(_ascending(d.get("aliases", [])) for d in dispatchers) and len(set(tokens)) == len(tokens), "kinds and aliases", 19)
    _need(all(re.fullmatch(r"[a-z][a-z0-9_]{0,63}", t) for t in tokens), "kinds and aliases", 19)
    for d in dispatchers:
        _need(programs.get(d.get("pre_canonicalization"), {}).get("kind") == "pre_canonicalization", f"{d['kind']}: pre-canonicalization", 16)
        aliases, targets = d.get("country_aliases", {}), d.get("targets", [])
        countries = [t["country"] for t in targets]
        _need(_ascending(list(aliases)) and all(a != c and a not in countries and c in countries for a, c in aliases.items()), f"{d['kind']}: country aliases", 20)
        prefixes = [x for t in targets for x in t.get("prefixes", [])]
        _need(targets and _ascending(countries) and len(set(prefixes)) == len(prefixes) and all(_ascending(t.get("prefixes", [])) for t in targets), f"{d['kind']}: targets", 21)
        _need(sum(not t.get("prefixes") for t in targets) <= 1 or len(prefixes) == 0, f"{d['kind']}: more than one target without prefix", 21)
        if "GLOBAL" in countries:
            _need(len(targets) == 1 and not prefixes and not aliases, f"{d['kind']}: GLOBAL is not alone", 22)
            steps = {n["op"] for t in targets for n in programs[by_id[t["definition"]]["canonicalization"]]["nodes"]} if all(t["definition"] in by_id for t in targets) else set()
            _need("canonicalization_prepend_country_if_missing" not in steps, f"{d['kind']}: GLOBAL prepends a country", 16)
        for t in targets:
            own = by_id.get(t["definition"])
            _need(own and own["kind"] == d["kind"] and own["country"] == t["country"], f"{d['kind']}: target {t['country']}", 23)
            referenced.append(t["definition"])
    _need(sorted(referenced) == sorted(by_id), "a definition is not referenced once", 23)


def _calls(programs: dict[int, dict]) -> None:
    depth: dict[int, int] = {}

    def of(i: int, above: tuple[int, ...]) -> int:
        _need(i not in above, f"program {i} calls itself", 24)
        _need(len(above) < MAX_DEPTH, "calls go too deep", 24)
        if i not in depth:
            inner = []
            for n in programs[i]["nodes"]:
                if n["op"] in ("call_format", "call_checksum"):
                    _need(programs.get(n["program"], {}).get("kind") == n["op"].removeprefix("call_"), f"program {i} calls {n['program']}", 24)
                    inner.append(of(n["program"], (*above, i)))
            depth[i] = 1 + max(inner, default=0)
        _need(depth[i] <= MAX_DEPTH, "calls go too deep", 24)
        return depth[i]

    for i in programs:
        of(i, ())
