"""The rule algebra: each operator is a function from columns to a column.

Strings are nullable columns where NULL stands for an absent view; integers are nullable
bigints where NULL stands for an indeterminate value; predicates are never NULL; an assertion
is a struct (reason_code, message_key) where NULL means it holds; an outcome is a struct
(status, reason_code, message_key) where NULL means it does not apply.
"""

from .assertions import require, sequence
from .canonical import CANONICAL_STEPS
from .outcomes import (
    all_checks,
    any_check,
    choose,
    compare_constant,
    compare_digit,
    compare_slice,
    luhn,
    mod97_10,
    unsupported,
    when,
)

__all__ = ["CANONICAL_STEPS", "all_checks", "any_check", "choose", "compare_constant", "compare_digit", "compare_slice", "luhn", "mod97_10", "require", "sequence", "unsupported", "when"]
