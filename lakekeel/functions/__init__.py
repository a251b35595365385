from lakekeel.functions.text import (
    branch_parts,
    build_kv_string,
    expand_template,
    is_blank,
    is_empty,
    is_guid,
    parse_kv_string,
    retarget,
    split_endpoint,
    unique_name,
)

__all__ = [
    "branch_parts",
    "build_kv_string",
    "expand_template",
    "is_blank",
    "is_empty",
    "is_guid",
    "parse_kv_string",
    "retarget",
    "split_endpoint",
    "unique_name",
]
