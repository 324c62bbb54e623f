from areashare.functions.codes import CodeSet, code_prefix
from areashare.functions.prefixes import PrefixSet
from areashare.functions.scalars import (
    as_percent,
    case_items,
    ieee_divide,
    missing_to_null,
    parse_period,
    period_date,
    period_label,
    scale_clamp,
)
from areashare.functions.sql import register_sql_functions

__all__ = [
    "CodeSet",
    "PrefixSet",
    "as_percent",
    "case_items",
    "code_prefix",
    "ieee_divide",
    "missing_to_null",
    "parse_period",
    "period_date",
    "period_label",
    "register_sql_functions",
    "scale_clamp",
]
