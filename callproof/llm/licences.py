"""Licence scans with DataFrame functions only: canonical digests of entire texts, joined to known licences.

A unit (a whole text, a block between blank lines, a line, or a stretch of as many blocks as a known text has) is put into canonical form: copyright lines
go, case and punctuation are levelled, equivalent spellings become one.  The digest of the entire canonical
unit is then looked up among the digests of known licences and notices in the same form: a hash join, with the
known table (a few dozen rows, its size checked) sent to all tasks.  Nothing else is shuffled.

Only units with one of the words that every known text has are put into canonical form; where the known texts
lack such words, all units are.  Defined results: one row per unit that is a known licence, so a null, empty or
other text has no row; a unit that is known under several names has a row for each; repeated rows give repeated
rows; a null ``doc_id`` is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Known notices and licences: fixed values, the wording of the licences themselves.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
_DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(name: str, version: str, or_later: bool) -> str:
    which = f"either version {version} of the License, or (at your option) any later version" if or_later else f"version {version} of the License"
    return f"""This {'library' if 'Lesser' in name else 'program'} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}.

This {'library' if 'Lesser' in name else 'program'} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


#: Further licences and standard headers; numbers before conditions are part of the text, so each form is listed.
FURTHER = [
    *[("BSD-2-Clause", f"{_FORMS}\n\n{a}{_SOURCE}\n\n{b}{_BINARY}\n\n{_DISCLAIMED}") for a, b in (("", ""), ("1. ", "2. "))],
    *[("BSD-3-Clause", f"{_FORMS}\n\n{a}{_SOURCE}\n\n{b}{_BINARY}\n\n{c}{_NAMES}\n\n{_DISCLAIMED}") for a, b, c in (("", "", ""), ("1. ", "2. ", "3. "))],
    *[("Apache-2.0", f"""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http{s}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""") for s in ("", "s")],
    *[("MPL-2.0", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{s}://mozilla.org/MPL/2.0/.") for s in ("", "s")],
    *[(f"{short}-{v}.0-{'or-later' if later else 'only'}".replace("2.1.0", "2.1"), _gnu(name, v, later)) for short, name, v in (("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3"), ("AGPL", "Affero General Public License", "3")) for later in (True, False)],
]
#: Long licences by the digests of their canonical forms: licence, blocks, digest of the first block, digest of the whole.
FULL_TEXTS = [
    ("Apache-2.0", 33, "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", "865f7b0d882ecbae362b1823e2ae250667dfad39760ffda9bada2c579ea3326f"),
    ("GPL-2.0", 59, "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 122, "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.1", 76, "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 37, "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", 81, "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", "cdb5877b9b73b693216820ac5a0090510c6fd9df7c38876e551b865cce774ddd"),
    ("CC0-1.0", 13, "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("Artistic-1.0-Perl", 29, "9fed8b0e06b2229a97a10906ed7a4e4608b849d85ed54da1ada55f2d05e8d9db", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
]
#: Title lines with which a body is known as well.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"]}
#: Spellings taken as one, on levelled text.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("judgement", "judgment"), ("percent", "per cent"), ("v2", "version 2"), ("v3", "version 3")]
#: A line that only says whose the text is.
COPYRIGHT = r"^[^\p{L}\p{N}©]*((copyright|copr)[^\p{L}\p{N}].*([0-9]{4}|\([cC]\)|©)|\([cC]\)|©|all rights reserved)"
MARKS = ["licen", "permission", "permitted"]
BLOCK_END = r"\n[ \t\r]*\n"
MOST_KNOWN = 10_000


def canonical(unit: Column) -> Column:
    """A text in canonical form."""
    lines = F.filter(F.split(F.lower(unit), "\n"), lambda line: ~line.rlike(COPYRIGHT))
    out = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, " "), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def all_known() -> list[tuple[str, str]]:
    """``KNOWN``, ``FURTHER``, and their bodies under their titles."""
    own = KNOWN + FURTHER
    return own + [(name, f"{title}\n{text}") for name, text in own if "\n" in text for title in TITLES.get(name, [])]


def known_licences(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(digest, licence)`` of the known texts; without ``known``, those of ``FULL_TEXTS`` are among them."""
    rows = all_known() if known is None else known
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    own = spark.createDataFrame(rows, "licence string, known string").select(digest(F.col("known")).alias("digest"), "licence")
    full = [(d, name) for name, _, _, d in FULL_TEXTS] if known is None else []
    return own.unionByName(spark.createDataFrame(full, "digest string, licence string")).distinct()


def first_blocks(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> dict[int, list[str]]:
    """Number of blocks -> the digests of the first blocks of the known texts that have so many; two blocks or more."""
    split = [re.split(BLOCK_END, t) for _, t in (all_known() if known is None else known)]
    rows = spark.createDataFrame([(len(b), b[0]) for b in split if len(b) > 1], "n int, block string").select("n", digest(F.col("block")).alias("d")).distinct().collect()  # of the known texts
    out: dict[int, list[str]] = {}
    for n, d in [(r["n"], r["d"]) for r in rows] + [(n, first) for _, n, first, _ in (FULL_TEXTS if known is None else [])]:
        out.setdefault(n, []).append(d)
    return out


def digest(unit: Column) -> Column:
    return F.sha2(canonical(unit), 256)


def licences(docs: DataFrame, known: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit that is a known licence: ``doc_id, unit, unit_no, licence, digest``."""
    texts = [t for _, t in (all_known() if known is None else known)]
    pattern = "(?i)" + "|".join(MARKS)
    marked = all(re.search(pattern, t) for t in texts)

    def units(kind: str, parts: Column) -> Column:
        each = F.transform(parts, lambda x, k: F.struct(F.lit(kind).alias("unit"), k.cast("long").alias("unit_no"), x.alias("content")))
        return F.when(F.size(parts) > 1, each).otherwise(F.slice(each, 1, 0)) if kind != "text" else each

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    if marked:
        own = own.where(F.col("text").rlike(pattern))
    own = own.withColumn("blocks", F.split("text", BLOCK_END))
    own = own.withColumn("begins", F.when(F.size("blocks") > 1, F.transform("blocks", digest)).otherwise(F.array().cast("array<string>")))

    # stretches of as many blocks as a known text has, but for the whole text, where the first block is that text's
    def stretches(n: int, firsts: list[str]) -> Column:
        starts = F.when(F.size("blocks") > n, F.filter(F.sequence(F.lit(0), F.size("blocks") - n), lambda k: F.get("begins", k).isin(*firsts))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(F.lit("blocks").alias("unit"), k.cast("long").alias("unit_no"), F.array_join(F.slice("blocks", k + 1, n), "\n\n").alias("content")))

    begun = sorted(first_blocks(docs.sparkSession, known).items())
    all_units = F.concat(units("text", F.array("text")), units("block", F.col("blocks")), units("line", F.split("text", "\n")), *[stretches(n, firsts) for n, firsts in begun])
    if marked:
        all_units = F.filter(all_units, lambda u: u["content"].rlike(pattern))
    rows = own.select("doc_id", "text", F.explode(all_units).alias("u")).select("doc_id", "text", "u.unit", "u.unit_no", digest(F.col("u.content")).alias("digest"))
    found = rows.join(F.broadcast(known_licences(docs.sparkSession, known)), "digest")
    # a stretch that leaves out only copyright lines is the whole text, which has its row
    return found.where((F.col("unit") != "blocks") | (digest(F.col("text")) != F.col("digest"))).select("doc_id", "unit", "unit_no", "licence", "digest")


def op3_query(spark, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"' ' || regexp_replace(array_to_string(list_filter(string_split(lower(X), chr(10)), lambda line: not regexp_matches(line, {quote(COPYRIGHT)})), ' '), {quote(r'[^\p{L}\p{N}]+')}, ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    form = f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    part = lambda kind, parts: f"select doc_id, '{kind}' as unit, unnest(range(0, len({parts}))) as unit_no, unnest({parts}) as content from documents where text is not null" + (f" and len({parts}) > 1" if kind != "text" else "")
    blocks = "string_split_regex(text, '\\n[ \\t\\r]*\\n')"
    return f"""
with known as (select distinct {form.replace('X', 'text', 1)} as digest, licence from (values {values}) as t(licence, text)),
units as ({part('text', '[text]')} union all {part('block', blocks)} union all {part('line', 'string_split(text, chr(10))')}),
digests as (select doc_id, unit, unit_no, {form.replace('X', 'content', 1)} as digest from units)
select doc_id, unit, unit_no, licence, digest from digests join known using (digest)
"""


OP3_SQL = _sql()
