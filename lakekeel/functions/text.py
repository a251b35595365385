"""Column functions on names, identifiers and connection text. All are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical identifier form, ASCII blanks and the line ends that split a text.
GUID_PATTERN = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
BLANKS = " \t\n\r\x0b\x0c"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def is_empty(c: Column | str) -> Column:
    """Null or empty; white space is not empty."""
    return F.coalesce(_col(c), F.lit("")) == ""


def is_guid(c: Column | str) -> Column:
    """True only for the hyphenated canonical form, in either case. Null, braces and bare hex are false."""
    return F.coalesce(F.lower(_col(c)).rlike(GUID_PATTERN), F.lit(False))


def split_endpoint(path: Column | str) -> Column:
    """``host;database`` as a struct; any other number of parts gives null in both fields."""
    parts = F.split(_col(path), ";", -1)
    ok = (_col(path) != "") & (F.size(parts) == 2)
    return F.struct(
        F.when(ok, strip(F.get(parts, F.lit(0)))).alias("sqlendpoint"),
        F.when(ok, strip(F.get(parts, F.lit(1)))).alias("database_name"),
    )


def build_kv_string(pairs: Sequence[tuple], quoted: Sequence[str] = ()) -> Column:
    """``k=v;`` for each pair; values of the keys in ``quoted`` get double quotes. A null value gives null."""
    out = []
    for key, value in pairs:
        q = '"' if key in quoted else ""
        out += [F.lit(f"{key}={q}"), _col(value).cast("string"), F.lit(f"{q};")]
    return F.concat(*out)


def parse_kv_string(c: Column | str) -> Column:
    """The map behind a ``k=v;`` string; the closing separator adds no empty key."""
    return F.str_to_map(F.regexp_replace(_col(c), r";\z", ""), F.lit(";"), F.lit("="))


def expand_template(template: Column | str, mapping: Mapping[str, Column | str]) -> Column:
    """Replace every ``{name}`` in one go; text, not a pattern. ``template`` as str is the template itself.

    Braces in the values stay as they are. A null value gives null.
    """
    out = F.lit(template) if isinstance(template, str) else template
    values = {"{" + name + "}": _col(value).cast("string") for name, value in mapping.items()}

    def filled(piece: Column) -> Column:
        done = piece
        for name, value in values.items():
            done = F.when(piece == name, value).otherwise(done)
        return done

    known = F.lit(True)
    for value in values.values():
        known = known & value.isNotNull()
    pieces = F.split(out, r"(?=\{)|(?<=\})", -1)
    return F.when(known & out.isNotNull(), F.array_join(F.transform(pieces, filled), ""))


def unique_name(name: Column | str, kind: Column | str) -> Column:
    """``name.type``; null if either part is null."""
    return F.concat(_col(name), F.lit("."), _col(kind))


def branch_parts(branch: Column | str, mode: str = "create") -> Column:
    """Struct of the trimmed branch and its last segment.

    ``create`` removes the markers wherever they occur, ``delete`` only as prefixes.
    """
    c = _col(branch)
    if mode == "create":
        trimmed = F.replace(F.replace(c, F.lit("feature/"), F.lit("")), F.lit("/feature"), F.lit(""))
    elif mode == "delete":
        trimmed = F.regexp_replace(F.regexp_replace(c, "^refs/heads/feature/", ""), "^feature/", "")
    else:
        raise ValueError("mode must be 'create' or 'delete'")
    return F.struct(trimmed.alias("branch"), F.substring_index(trimmed, "/", -1).alias("short_name"))


def retarget(name: Column | str, env: Column | str, marker: str = "dev") -> Column:
    """``[marker]`` in the name becomes ``[env]``; names without the marker stay as they are."""
    return F.replace(_col(name), F.lit(f"[{marker}]"), F.concat(F.lit("["), _col(env), F.lit("]")))


def strip_noise(text: Column | str, prefixes: Sequence[str]) -> Column:
    """Drop the lines whose trimmed form starts with one of ``prefixes``; the whole text is trimmed first."""

    def keep(line: Column) -> Column:
        noise = F.lit(False)
        for p in prefixes:
            noise = noise | strip(line).startswith(p)
        return ~noise

    return F.array_join(F.filter(F.split(strip(text), LINE_END, -1), keep), "\n")


# The two text forms below define what is rewritten.
def quoted_head(text: Column | str, value: str) -> Column:
    """Swap the quoted string that opens the text if ``meta [`` follows it; other texts stay unchanged."""
    safe = value.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(_col(text), r'^"[^"]+"(\s+meta\s+\[)', f'"{safe}"$1')


def named_expression_pattern(target: str) -> str:
    return rf'(expression\s+{re.escape(target)}\s*=\s*")[^"]+("[^\n]*meta\s*\[[^\n]*\])'
