"""License scan by canonical digests.

A text and each known licence are brought to one canonical form: A-Z lower-cased, typographic marks made plain,
copyright lines and "all rights reserved" removed, equivalent spellings unified, punctuation and white space made single
spaces. The digests of the whole text, of its blocks between blank lines and of its lines, each an entire text of its
own, then meet the digests of the known licences in an equi-join. Licences over several lines or blocks are looked for as
runs of lines, whatever their breaks. Only SQL functions are used.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Licence texts and the sentences by which texts refer to a licence.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Further licence texts and their standard notices, one file each, named by SPDX id and a variant after ``--``.
TEXTS = Path(__file__).with_name("license_texts")
#: Each built-in text holds one of these, in lower case.
WORDS = ("licen", "software")

#: Spellings that count as equal, on lower-case text without punctuation.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"),
    ("sub licensed", "sublicensed"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("centre", "center"), ("per cent", "percent"), ("https", "http"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TYPOGRAPHIC, _PLAIN = "‘’“”‐‑‒–—«» ", "''\"\"-----\"\" "
_COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|\x{a9})[^a-z0-9\n]*(\(c\)[^a-z0-9\n]*)?[0-9]{4}[^\n]*"
_RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)"
_PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"


def _quoted(text: str, dialect: str) -> str:
    if dialect == "spark":
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + text.replace("'", "''") + "'"


def _replaced(text: str, pattern: str, by: str, dialect: str) -> str:
    flags = "" if dialect == "spark" else ", 'g'"
    break_ = "'\\n'" if dialect == "spark" else "chr(10)"
    by = break_ if by == "\n" else f"concat(' ', {break_}, ' ')" if by == " \n " else _quoted(by, dialect)
    return f"regexp_replace({text}, {_quoted(pattern, dialect)}, {by}{flags})"


def canonical_sql(text: str, dialect: str = "spark") -> str:
    """SQL for the canonical form of a text, for Spark or DuckDB; line breaks are kept."""
    plain = (_quoted(_UPPER + _TYPOGRAPHIC, dialect), _quoted(_LOWER + _PLAIN, dialect))
    out = f"translate({text}, {plain[0]}, {plain[1]})"
    out = _replaced(out, _COPYRIGHT, "\n", dialect)
    out = _replaced(out, _RESERVED, "\n", dialect)
    out = _replaced(out, _PUNCTUATION, " ", dialect)
    out = f"concat(' ', {_replaced(out, ' ?' + chr(92) + 'n ?', ' ' + chr(10) + ' ', dialect)}, ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return _replaced(out, r" *\n *", "\n", dialect)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in licences."""
    files = [(p.stem.split("--")[0], p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame([*KNOWN, *files], "license_id string, text string")


def _form() -> str:
    return f"trim(BOTH ' \\n' FROM {canonical_sql('text')})"


def digests(texts: DataFrame, key: str) -> DataFrame:
    """(key, whole, digest) of every unit of every text; whole tells the entire text from its blocks and lines."""
    form = texts.selectExpr(f"`{key}`", f"{_form()} AS form")
    parts = r"array_distinct(concat(split(form, '\n\n+'), split(form, '\n')))"
    # no filter here: it would be pushed below the form and make it a second time; null and empty units go below
    units = form.selectExpr(
        f"`{key}`",
        "inline(concat(array(struct(true AS whole, form AS unit)),"
        f" transform({parts}, u -> struct(false AS whole, u AS unit))))",
    )
    return units.filter("unit <> ''").selectExpr(
        f"`{key}`", "whole", r"sha2(trim(regexp_replace(unit, '\\n+', ' ')), 256) AS digest"
    )


def runs(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """(doc_id, license_id, whole) of every run of two or more lines that is a licence, blank lines among them or not.

    Runs that are a block of their own or the entire text are left to ``digests``.
    """
    flat = r"regexp_replace(form, '\n+', ' ')"
    known = licenses.selectExpr("license_id", f"{_form()} AS form").selectExpr("license_id", f"{flat} AS known")
    known = F.broadcast(known.filter("known <> ''").distinct())
    # a text with the licence's words in it, at whatever place
    texts = docs.selectExpr("doc_id", f"{_form()} AS form").selectExpr("doc_id", "form", f"concat(' ', {flat}, ' ') AS flat")
    both = texts.join(known, F.expr("contains(flat, concat(' ', known, ' ')) AND flat <> concat(' ', known, ' ')"))
    both = both.selectExpr("doc_id", "license_id", "known", r"split(regexp_replace(form, '\n\n+', '\n\n'), '\n') AS lines")
    starts = "filter(sequence(1, size(lines)), i -> lines[i - 1] <> '' AND startswith(known, concat(lines[i - 1], ' ')))"
    # lines up to which the run is as long as the licence
    taken = (
        "aggregate(slice(lines, i, 2 * length(known)), struct(-1 AS len, 0 AS n), (s, x) -> if(s.len < length(known),"
        " struct(s.len + if(x = '', 0, 1 + length(x)) AS len, s.n + 1 AS n), s)).n"
    )
    units = f"transform({starts}, i -> array_join(slice(lines, i, {taken}), '\\n'))"
    same = r"filter(array_distinct(units), u -> regexp_replace(u, '\n+', ' ') = known)"
    blocks = r"split(array_join(lines, '\n'), '\n\n')"
    found = both.selectExpr("doc_id", "license_id", "known", "lines", f"{units} AS units")
    return found.selectExpr("doc_id", "license_id", f"explode(array_except({same}, {blocks})) AS unit").selectExpr(
        "doc_id", "license_id", "false AS whole"
    )


def scanned(docs: DataFrame, licenses: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """Licences found: doc_id, license_id, n_units (lines, blocks and runs of lines equal to it), whole_text (the text is
    nothing else).

    A line that is a block of its own counts once. Null and empty texts, and texts without letters or digits, give no
    row; repeated rows of one document add up; null ids are a document of their own. Licences with one canonical form
    and several names are all reported, and so is one inside another; other columns are ignored. Where each licence holds
    one of some ``words`` (lower case), runs are looked for in the documents with such a word only.
    """
    known = digests(licenses, "license_id").filter("whole").select("license_id", "digest").distinct()
    found = digests(docs, "doc_id").join(known, "digest").select("doc_id", "license_id", "whole")
    if words:
        docs = docs.filter(" OR ".join(f"contains(lower(text), '{w}')" for w in words))
    found = found.union(runs(docs, licenses))
    return found.groupBy("doc_id", "license_id").agg(
        F.count(F.expr("if(whole, NULL, 1)")).alias("n_units"), F.max("whole").alias("whole_text")
    )


def oracle_sql() -> str:
    """The scan of ``documents`` for the built-in licences as DuckDB SQL."""

    def units(table: str, key: str) -> str:
        form = f"trim({canonical_sql('text', 'duckdb')}, ' ' || chr(10))"
        return (
            f"SELECT {key}, whole, sha256(trim(regexp_replace(unit, chr(10) || '+', ' ', 'g'))) AS digest FROM ("
            f"SELECT {key}, true AS whole, form AS unit FROM (SELECT {key}, {form} AS form FROM {table}) UNION ALL "
            f"SELECT {key}, false, unnest(list_distinct(list_concat(string_split_regex(form, chr(10) || chr(10) || '+'),"
            f" string_split(form, chr(10))))) FROM (SELECT {key}, {form} AS form FROM {table}) WHERE form <> '') "
            "WHERE unit <> ''"
        )

    known = ", ".join(f"({_quoted(name, 'duckdb')}, {_quoted(text, 'duckdb')})" for name, text in KNOWN)
    return (
        f"WITH known AS (SELECT * FROM (VALUES {known}) AS k(license_id, text)), "
        f"names AS (SELECT DISTINCT license_id, digest FROM ({units('known', 'license_id')}) WHERE whole) "
        "SELECT doc_id, license_id, count(CASE WHEN NOT whole THEN 1 END) AS n_units, bool_or(whole) AS whole_text "
        f"FROM ({units('documents', 'doc_id')}) JOIN names USING (digest) GROUP BY doc_id, license_id"
    )
