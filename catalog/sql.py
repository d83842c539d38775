"""Pieces of the SQL counterparts (DuckDB): rounding, text parsing, and generated column lists."""

from __future__ import annotations

from catalog.dirty import LINEITEM

DIRTY = LINEITEM.replace("{lineitem}", "lineitem")

TOKENS = (
    "('', 'n/a', 'na', 'null', 'none', 'nan', '?', '-', '--', 'unknown', 'pending', 'pending...', 'missing', "
    "'zero', '$ -', 'free', 'call for price', '0000-00-00')"
)
UNITS = r"usd|eur|gbp|sqft|sq\s*ft|mg/dl|kg|lbs|mmhg"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def rnd(expr: str, digits: int) -> str:
    """Rounding half up on the decimal form, as Spark rounds a double."""
    return f"cast(round(cast({expr} as decimal(38,12)), {digits}) as double)"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def token(x: str) -> str:
    return f"(lower({trim(x)}) in {TOKENS})"


def no_token(x: str) -> str:
    return f"(case when not {token(x)} then {x} end)"


def num(x: str) -> str:
    bare = f"translate({x}, '$,€£¥%', '')"
    glued = rf"regexp_replace({bare}, '(?i)([0-9])\s*(?:{UNITS})\b', '\1', 'g')"
    words = trim(rf"regexp_replace({glued}, '(?i)\b(?:{UNITS})\b', '', 'g')")
    pattern = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return f"(case when regexp_matches({words}, '{pattern}') then try_cast({words} as double) end)"


def ts(x: str) -> str:
    t = trim(x)
    return (
        f"(case when regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_cast({t} as timestamp)"
        f" when regexp_matches({t}, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') then try_cast(replace({t}, '/', '-') as timestamp)"
        f" when regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') then try_strptime({t}, '%m/%d/%Y')"
        f" when regexp_matches({t}, '^[0-9]{{1,2}}-[A-Za-z]{{3}}-[0-9]{{4}}$') then try_strptime({t}, '%d-%b-%Y')"
        f" when regexp_matches({t}, '^[A-Za-z]{{3}} [0-9]{{1,2}}, [0-9]{{4}}$') then try_strptime({t}, '%b %d, %Y') end)"
    )


def spaced(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '\s+', ' ', 'g')"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '([a-zA-Z]+|[^a-zA-Z]+)'), "
        "lambda r: upper(r[1]) || substr(r, 2)), '')"
    )


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def lit(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def clean_names(table: str, prefix: str, columns: list[str]) -> str:
    """A table with the prefix of its column names removed."""
    return "(select " + ", ".join(f"{c} as {c[len(prefix):]}" for c in columns) + f" from {table})"
