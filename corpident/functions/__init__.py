"""The API: validate, validate_format, validate_checksum, canonicalize, rules_info, capabilities."""

from corpident.plans.ruleset import Ruleset

from .engine import Registers, canonicalize, capabilities, rules_info, validate, validate_checksum, validate_format
from .reports import flatten, report_json, verdict_summary

__all__ = ["Registers", "Ruleset", "canonicalize", "capabilities", "flatten", "report_json", "rules_info", "validate", "validate_checksum", "validate_format", "verdict_summary"]
