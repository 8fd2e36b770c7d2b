"""Fields of the ``raw`` JSON payload, and checks on free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wlanlake.functions.labels import squash
from wlanlake.functions.util import col_of, strip

RAW_SCHEMA = (
    "iface string, sa string, da string, bssid string, len long, type long, subtype long, "
    "rate double, sig double, ssid string, sim string, sim_batch string, sim_class string"
)

# Code points that render as nothing or reorder what follows.
HIDDEN_CLASS = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}]"
# Control codes other than tab, line feed and carriage return.
CONTROL_CLASS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"

def raw_field(raw, name: str) -> Column:
    """One field of the payload as text; NULL when absent or when the payload is no JSON object."""
    return F.get_json_object(col_of(raw), f"$.{name}")


def is_simulated(raw) -> Column:
    """True when the payload's ``sim`` is truthy (by its JSON type); never NULL."""
    value = F.try_variant_get(F.try_parse_json(col_of(raw)), "$.sim", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    truthy = (
        F.when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
        .when(F.startswith(kind, F.lit("ARRAY")), text != "[]")
        .otherwise(text.try_cast("double") != 0)
    )
    return F.coalesce(truthy, F.lit(False))


def mac_contains(mac, needle: str) -> Column:
    """Separator- and case-blind search in an address."""
    key = "".join(ch for ch in needle.lower() if ch.isascii() and ch.isalnum())
    return F.contains(F.coalesce(squash(mac), F.lit("")), F.lit(key))


def text_admissible(c, max_chars: int) -> Column:
    """NULL when a text may pass, else the reason it may not.

    Length first (before any trimming), then whichever forbidden character comes first,
    then emptiness.
    """
    text = col_of(c)
    control, hidden = text.rlike(CONTROL_CLASS), text.rlike(HIDDEN_CLASS)
    # Which of the two comes first only matters when both occur.
    before_control = F.regexp_extract(text, f"(?s)^(.*?){CONTROL_CLASS}", 1)
    return (
        F.when(text.isNull(), "not_a_string")
        .when(F.char_length(text) > max_chars, "too_long")
        .when(control & ~before_control.rlike(HIDDEN_CLASS), "control_character")
        .when(hidden, "hidden_character")
        .when(strip(text) == "", "empty")
    )
