"""Licence texts by the digest of their canonical form.

A text is brought to a canonical form (case, copyright lines, punctuation,
spelling), digested, and joined with the digests of known licences. Whole texts
are compared: a licence inside a longer text does not match. Expressions only; the
known digests are a short fixed list, hence safe to broadcast.

Defined results: a null text is an empty one, which matches nothing; repeated rows
give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings held to be equal, and what stands for both.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted"
)
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Licence texts and one-line notices.
KNOWN = (
    ("0BSD", f"{_GRANT}. {_NO_WARRANTY}"),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_NO_WARRANTY}"),
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_TERMS + _BSD_END),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_TERMS + _BSD_NAMES + _BSD_END),
    ("notice-MIT", "Released under the MIT License."),
    ("notice-Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice-GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
)

QUOTES = ("“”„«»‘’‚–—‐‑", '""""""\'\'\'---')
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line of its own that names a holder or a year. A wrapped licence may well begin a
# line with "copyright notice" or "COPYRIGHT HOLDERS"; those lines stay.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*([Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t:]*(\([cC]\)|©|[0-9]{4}|[\[<{])|Copyright[ \t]+[A-Z][a-z.]"
    r"|\([cC]\)[ \t]|©|[Aa]ll [Rr]ights [Rr]eserved)[^\n]*"
)
MOST_BROADCAST = 10_000
MARKS = r"[\x00-\x20!-/:-@\[-`{-~\x7f]+"


def canonical(text):
    """Canonical form of a text column."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    t = F.translate(F.translate(t, *QUOTES), UPPER, LOWER)
    # Two blanks between words and one around, so that every word has its own.
    t = F.concat(F.lit(" "), F.regexp_replace(t, MARKS, "  "), F.lit(" "))
    for odd, plain in SPELLINGS:
        t = F.replace(t, F.lit(f" {odd} "), F.lit(f" {plain} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def matched(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, licence``: the licence a whole text is, or null.

    ``known`` is a table ``licence, text`` of licences to look for beside the built-in
    ones; where texts are alike in canonical form the smallest name is given. Up to
    ``MOST_BROADCAST`` digests are broadcast, more are joined by shuffling.
    """
    spark = docs.sparkSession
    texts = spark.createDataFrame(list(KNOWN), "licence string, text string")
    if known is not None:
        texts = texts.unionByName(known.select("licence", "text"))
    digests = texts.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("licence").alias("licence"))
    if known is None or known.limit(MOST_BROADCAST).count() < MOST_BROADCAST:
        digests = F.broadcast(digests)
    found = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return found.join(digests, "digest", "left").select("doc_id", "digest", "licence")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The same canonical form for DuckDB."""
    t = f"replace(coalesce({text}, ''), chr(13), chr(10))"
    t = f"regexp_replace({t}, {_sql_text(COPYRIGHT_LINE)}, chr(10), 'g')"
    t = f"translate(translate({t}, {_sql_text(QUOTES[0])}, {_sql_text(QUOTES[1])}), '{UPPER}', '{LOWER}')"
    t = f"' ' || regexp_replace({t}, {_sql_text(MARKS)}, '  ', 'g') || ' '"
    for odd, plain in SPELLINGS:
        t = f"replace({t}, ' {odd} ', ' {plain} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def matched_sql() -> str:
    values = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN)
    return (
        f"WITH known AS (SELECT min(licence) AS licence, digest FROM (SELECT licence, sha256({canonical_sql('known')}) "
        f"AS digest FROM (VALUES {values}) AS v(licence, known)) GROUP BY digest) "
        f"SELECT d.doc_id, d.digest, k.licence FROM (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents) d "
        "LEFT JOIN known k ON d.digest = k.digest"
    )
