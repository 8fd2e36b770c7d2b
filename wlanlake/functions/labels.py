"""Class names, front keys, severities and free-text class lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.util import col_of, lookup, strip


def normalise_label(c) -> Column:
    """Class name of a raw label: exact spelling first, then folded aliases, else NULL."""
    s = strip(c)
    return F.coalesce(F.when(s.isin(spec.CLASSES), s), lookup(spec.LABEL_ALIASES, F.lower(s)))


def label_id(c) -> Column:
    """Position of a class name in the class list."""
    return lookup(spec.LABEL_ID, c).cast("tinyint")


def label_name(c) -> Column:
    """Class name of a label id."""
    names = F.array(*[F.lit(x) for x in spec.CLASSES])
    return F.get(names, col_of(c).cast("int"))


def front_key(c) -> Column:
    return F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9_]", "")


def front_type(c) -> Column:
    """Front key of a stored class, ``other`` for anything the class list lacks."""
    return F.coalesce(lookup(spec.FRONT_KEY_OF, c), F.lit("other"))


def squash(c) -> Column:
    """Lower case without separators: ``5A:11`` and ``5a11`` become equal."""
    return F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9]", "")


def attack_type(c) -> Column:
    """UI type of whatever a class was called; ``other`` when unknown."""
    key = squash(c)
    return F.coalesce(
        F.when(key.isin(spec.UI_TYPES), key), lookup(spec.UI_ALIASES, key), F.lit("other")
    )


def severity(type_col) -> Column:
    return F.coalesce(lookup(spec.SEVERITY_OF, type_col), F.lit("info"))


_KEYS = {key: name for name, key in spec.FRONT_KEY_OF.items()}
_WORDINGS = {wording: _KEYS[key] for wording, key in spec.PHRASE_ALIASES.items() if key in _KEYS}


def resolve_class(c) -> Column:
    """Class named by free text: by its key, or by a wording whatever stands between the words."""
    words = F.regexp_extract_all(F.lower(strip(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    by_key = [lookup(_KEYS, key) for key in (front_key(strip(c)), F.array_join(words, "_"))]
    by_wording = [lookup(_WORDINGS, F.array_join(words, between)) for between in (" ", "")]
    return F.coalesce(*by_key, *by_wording)
