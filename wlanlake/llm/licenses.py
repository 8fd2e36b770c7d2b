"""Licence texts by canonical digest."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wlanlake.llm.common import ascii_lower

# Licence texts and one-line notices, each with its SPDX identifier.
_BUILT_IN = [
    (
        "MIT",
        """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """BSD Zero Clause License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]
# What may stand above a text, instead of its own title lines, or be left out.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero-Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# The first words below the title lines of texts that have none in TITLES.
_BODIES = {
    "Apache-2.0": "TERMS AND CONDITIONS FOR USE",
    "CC0-1.0": "Statement of Purpose",
    "MPL-2.0": "1. Definitions",
    "MPL-1.1": "1. Definitions",
}


def _variants(license: str, text: str) -> list[str]:
    """Ways to write one text: title lines (none, its own, others), list numbers, what follows its end."""
    above = TITLES.get(license)
    if above:
        own = re.match(r"[^\n]*\n", text)[0]
        bodies = [text[len(own) :] if own.strip() in above else text]
        if license.startswith("BSD-"):
            bodies.append(re.sub(r"(?m)^\d\. ", "* ", bodies[0]))
        return [t for body in bodies for t in [body, *(f"{title}\n{body}" for title in above)]]
    out = [text]
    below = re.search(r"(?m)^\s*(=+\s*)?END OF TERMS AND CONDITIONS", text)
    if below:
        out += [text[: below.start()], text[: below.end()]]
    start = re.search(rf"(?m)^\s*{_BODIES[license]}" if license in _BODIES else r"(?m)^ *(Everyone is permitted|Preamble|0\. )", text)
    if start:
        out += [t[start.start() :] for t in out]
    # The line that a user of the Apache licence fills in is then a copyright line.
    return out + [t for t in (re.sub(r"(?m)^\s*Copyright [\[{]yyyy[^\n]*\n", "", t) for t in out) if t not in out]


def _known() -> list[tuple[str, str]]:
    texts = [(f.stem, f.read_text("utf-8")) for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]
    whole = [(name, text) for name, text in [*_BUILT_IN, *texts] if "\n" in text]
    return _BUILT_IN + [(name, v) for name, text in whole for v in _variants(name, text)]


KNOWN = _known()
# Every known text has one of these inside a word that no spelling changes, as the tests make sure.
ANCHORS = ("licen", "merchantab")
# Words that licence texts use for each other; two blanks where a pair has two words.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favourite", "favorite"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicences", "sublicenses"),
    ("utilisation", "utilization"),
    ("wilful", "willful"),
    ("https", "http"),
    ("sub  license", "sublicense"),
    ("sub  licensed", "sublicensed"),
    ("sub  licenses", "sublicenses"),
    ("non  infringement", "noninfringement"),
    ("non  commercial", "noncommercial"),
    ("per  cent", "percent"),
    ("copyright  owner", "copyright  holder"),
    ("copyright  owners", "copyright  holders"),
]
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[^a-z\n]*(\(c\)|©|[0-9<])|\(c\)|©|all rights reserved)[^\n]*"
BETWEEN = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, words alone with one blank between, one spelling."""
    out = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, BETWEEN, "  "), F.lit(" "))
    for other, word in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_digests(spark, texts: DataFrame | None = None) -> DataFrame:
    """text_digest, license: canonical digests of a table (license, text), or of the fixed texts."""
    known = spark.createDataFrame(KNOWN, "license string, text string") if texts is None else texts
    return known.select(F.sha2(canonical(F.col("text")), 256).alias("text_digest"), "license").distinct()


def scan_licenses(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, text_digest, license, notices.

    ``text_digest`` is the SHA-256 of the whole text in canonical form, ``license`` the known licence that
    has it, by a hash join. ``notices`` has the identifiers of known licences whose whole text is one line
    of the document, sorted, with commas. ``known`` (text_digest, license; see ``known_digests`` for one
    from other texts) is a table of fixed size that the planner may broadcast; its digests must be distinct.

    Null and empty texts, and texts of copyright lines alone, have the digest of the empty text and no
    licence. Null ids are kept; repeated rows are rows of their own. An empty table gives no rows. Other
    columns are not read.
    """
    # Of the fixed texts it is known what a line must have; lines are then put into canonical form only if they have it.
    anchors = ANCHORS if known is None else ()
    known = known_digests(df.sparkSession) if known is None else known
    listed = F.array(*[F.lit(x) for r in sorted(known.collect()) for x in (r["text_digest"], r["license"])])
    digests = F.filter(listed, lambda x, i: i % 2 == 0)
    names = F.filter(listed, lambda x, i: i % 2 == 1)
    lines = F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "\n")
    if anchors:
        lines = F.filter(lines, lambda x: reduce(or_, [x.contains(a) for a in anchors]))
    places = F.transform(lines, lambda x: F.array_position(digests, F.sha2(canonical(x), 256)).cast("int"))
    found = F.transform(F.filter(places, lambda p: p > 0), lambda p: F.element_at(names, p))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(canonical(F.col(text_col)), 256).alias("text_digest"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"),
    )
    return rows.join(known, "text_digest", "left").select("doc_id", "text_digest", "license", "notices")
