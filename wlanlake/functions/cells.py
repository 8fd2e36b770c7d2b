"""Parsing of capture cells: numbers, repeated numbers, presence, MAC addresses.

Every function takes the SQL text of a string expression (usually a column name) and
returns SQL text. Frame features use some sixty of them in one projection; as text the
whole projection reaches the JVM in one call per column, and ``F.expr`` turns any single
one into a Column. ``clean`` says that the expression is stripped already, which pays when
a cell is looked at more than once.
"""

from __future__ import annotations

# Texts that mean "the frame did not carry the field".
NUMBER_BLANKS = ["", "?", "nan", "NaN", "-", "None"]
PRESENCE_BLANKS = ["", "?", "nan", "NaN", "-"]
MAC_BLANKS = ["", "?", "nan", "-"]
# What counts as one number, and how numbers are found in a signed series.
DIGITS = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
NUMBER_PATTERN = rf"^[+-]?(?:{DIGITS}(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))$"
SERIES_PATTERN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
BROADCAST_MAC = "ff:ff:ff:ff:ff:ff"

SPACES = r" \t\r\n\u000b\u000c"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _one_of(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def strip(c: str) -> str:
    """Trim every kind of white space, not only blanks."""
    return f"btrim({c}, '{SPACES}')"


def _number(s: str) -> str:
    # The pattern keeps out Java's own spellings ("1d", "0x1p3"), which a cast would take.
    return f"if({s} rlike {_quoted(NUMBER_PATTERN)}, try_cast({s} as double), null)"


def _numbers(parts: str) -> str:
    return f"filter(transform({parts}, p -> {_number(strip('p'))}), x -> x is not null)"


def _hex(s: str) -> str:
    return (
        f"if({s} rlike '^0[xX][0-9a-fA-F]+$', try_cast(conv(substring({s}, 3), 16, 10) as double), null)"
    )


def parse_multi(c: str, clean: bool = False) -> str:
    """All numbers in a cell as ``array<double>``; empty when the cell is blank.

    Repeated fields come joined by ``-``, so a leading sign decides between a signed
    series and a separator. Hex and comma lists are recognised; unreadable parts are
    skipped.
    """
    s = c if clean else strip(c)
    none = "cast(array() as array<double>)"
    return f"""case
        when {s} is null or {s} in {_one_of(NUMBER_BLANKS)} then {none}
        when {s} rlike {_quoted(NUMBER_PATTERN)} then array(try_cast({s} as double))
        when {s} ilike '0x%' then filter(array({_hex(s)}), x -> x is not null)
        when contains({s}, ',') then {_numbers(f"split({s}, ',')")}
        when startswith({s}, '-') then
            {_numbers(f"regexp_extract_all({s}, {_quoted(SERIES_PATTERN)}, 0)")}
        else {_numbers(f"split({s}, '-')")} end"""


def _first_part(s: str, separator: str, sign: str) -> str:
    """First readable part of a list, found by one pattern instead of building the list."""
    gap = rf"\s*"
    part = rf"({sign}{DIGITS}(?:[eE]{sign}[0-9]+)?)"
    pattern = rf"(?:^|{separator}){gap}{part}{gap}(?=$|{separator})"
    return f"try_cast(regexp_extract({s}, {_quoted(pattern)}, 1) as double)"


def first_number(c: str, clean: bool = False) -> str:
    """First number of a cell, or NULL. Builds no array, so it stays in generated code.

    Nearly every cell is one plain number. Those are told by their last character and by
    what they do not contain, which is cheaper than a pattern; all else is looked at closely.
    """
    s = c if clean else strip(c)
    plain = (
        f"right({s}, 1) <= '9' and locate('-', {s}, 2) = 0 and not contains({s}, ',') "
        f"and not contains({s}, 'x') and not contains({s}, 'X')"
    )
    closely = f"""case
        when {s} in {_one_of(NUMBER_BLANKS)} then null
        when {s} rlike {_quoted(NUMBER_PATTERN)} then try_cast({s} as double)
        when {s} ilike '0x%' then {_hex(s)}
        when contains({s}, ',') then {_first_part(s, ",", "[+-]?")}
        when startswith({s}, '-') then
            try_cast(regexp_extract({s}, {_quoted(SERIES_PATTERN)}, 0) as double)
        else {_first_part(s, "-", "[+]?")} end"""
    return f"coalesce(if({plain}, try_cast({s} as double), null), if({c} is null, null, {closely}))"


def sum_number(c: str, clean: bool = False) -> str:
    """Sum of all numbers in a cell, NULL when there is none."""
    xs = parse_multi(c, clean)
    return f"reduce({xs}, cast(null as double), (a, x) -> coalesce(a, 0D) + x)"


def first_int(c: str, clean: bool = False) -> str:
    """First number cut to an integer (towards zero)."""
    return f"try_cast({first_number(c, clean)} as bigint)"


def present(c: str, clean: bool = False) -> str:
    """1 when the cell carries anything, else 0. The text ``None`` counts as carried."""
    s = c if clean else strip(c)
    return f"if({s} is null or {s} in {_one_of(PRESENCE_BLANKS)}, 0, 1)"


def norm_mac(c: str) -> str:
    """Lower-case first address of a cell, NULL when blank."""
    s = f"lower({strip(c)})"
    first = strip(f"substring_index({s}, ',', 1)")
    return f"if({s} in {_one_of(MAC_BLANKS)}, null, if(contains({s}, ','), nullif({first}, ''), {s}))"


def mac_is_broadcast(mac: str) -> str:
    return f"cast(coalesce(lower({strip(mac)}) = '{BROADCAST_MAC}', false) as int)"


def _octet_ends_with(mac: str, digits: str) -> str:
    return f"if({mac} rlike '^\\\\s*[0-9a-fA-F]*[{digits}]\\\\s*(:|$)', 1, 0)"


def mac_is_group(mac: str) -> str:
    """Group bit, the lowest of the first octet: its last hex digit is odd."""
    return _octet_ends_with(mac, "13579bdfBDF")


def mac_is_local(mac: str) -> str:
    """Locally administered bit, the second of the first octet."""
    return _octet_ends_with(mac, "2367abefABEF")
