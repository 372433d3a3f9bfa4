"""License scans by canonical digest lookup.

Texts are brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings do not matter) and whole texts are hash-joined by SHA-256
with known licences.  Lines are looked up the same way among one-line notices.
DataFrame functions only; no shuffle, since the known table is broadcast.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same in a licence (as the public
#: licence-matching guidelines list them), each with the form kept.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]
#: Spellings of more than one word.
PHRASES = [
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("sub licensed", "sublicensed"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("all rights reserved", ""),
]

#: Lines that only state who holds the copyright.
COPYRIGHT = (r"(^|\n)[^\p{L}\p{N}\n]*(copyright|copr)[^\p{L}\p{N}\n]*(c[^\p{L}\p{N}\n]|[0-9]{4}|year|yyyy)[^\n]*"
             r"|(^|\n)[ \t]*(©|\(c\))[^\n]*")
BREAKS = r"[^\p{L}\p{N}\n]+"

_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
          "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
          "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, "
             "this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the "
             "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
             "other materials provided with the distribution.\n")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.\n")
_BSD_TAIL = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
             "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
             "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
             "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
             "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
             "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
             "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
             "DAMAGE.")
_ISC_TAIL = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
             "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
             "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
             "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
             "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")

#: Short public licence texts and one-line notices.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software.\n" + _AS_IS),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
              'documentation files (the "Software"), to deal in the Software without restriction, including without '
              "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
              "Software, and to permit persons to whom the Software is furnished to do so.\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3 + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted.\n" + _ISC_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Longer licences, whole: one file each, named by its id.
TEXTS = Path(__file__).parent / "license_texts"
#: Where the terms end; often copied without what follows (how to apply them).
TERMS_END = "END OF TERMS AND CONDITIONS"
#: Known licences up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 10_000


def _respelled(padded: Column, pairs) -> Column:
    """``padded`` has two blanks around each word, so neighbours never share one."""
    for old, new in pairs:
        padded = F.replace(padded, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} " if new else "  "))
    return padded


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line breaks, two blanks around each word."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1$4")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), BREAKS, "  ")
    t = F.concat(F.lit("  "), F.replace(t, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    return _respelled(_respelled(t, SPELLINGS), PHRASES)


def canonical_text(lines: Column) -> Column:
    """One line, single blanks, from ``canonical_lines``."""
    return F.trim(F.regexp_replace(_respelled(F.regexp_replace(lines, "[ \\n]+", "  "), PHRASES), " +", " "))


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in licences and notices; terms with an appendix also without it."""
    known = list(KNOWN)
    for p in sorted(TEXTS.iterdir()):
        text = p.read_text("utf-8")
        known.append((p.stem, text))
        if TERMS_END in text:
            known.append((p.stem, text[:text.index(TERMS_END) + len(TERMS_END)]))
    return known


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of :func:`known_texts`."""
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, n_chars): one row a digest, the first id by code point for equal texts; empty texts go."""
    c = known.select("license_id", canonical_text(canonical_lines(known["text"])).alias("c")).where("c <> '' and license_id is not null")
    return c.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("c")).alias("n_chars"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence of each document, by the digest of its whole canonical text, and the notices among its lines.

    Returns id, canon_chars, digest, license (null: not a known licence),
    notices (ids of lines that are known texts of their own, distinct and
    sorted, comma-joined), n_notices (such lines, repeats counted).

    One output row per input row: null and empty texts have the digest of the
    empty text and no licence; repeated rows stay; other columns are ignored.
    An empty ``known`` leaves license null.
    """
    digests = known_digests(known)
    rows = digests.limit(BROADCAST_ROWS + 1).collect()
    lines = canonical_lines(docs[text_col])
    base = docs.select(docs[id_col].alias("doc_id"), lines.alias("lines"))
    base = base.select("doc_id", "lines", canonical_text(F.col("lines")).alias("c"))
    base = base.select("doc_id", "lines", F.length("c").cast("long").alias("canon_chars"), F.sha2("c", 256).alias("digest"))
    parts = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: F.length(x) > 0)
    if len(rows) > BROADCAST_ROWS:
        return _scan_by_shuffle(base.withColumn("key", F.sha2("lines", 256)), digests, parts)
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in rows], "digest string, license string"))
    longest = max([r[2] for r in rows], default=0)
    ids = F.create_map(*[F.lit(v) for r in rows for v in (r[0], r[1])]) if rows else F.lit(None).cast("map<string,string>")
    found = F.filter(parts, lambda x: F.length(x) <= longest)
    found = F.filter(F.transform(found, lambda x: F.try_element_at(ids, F.sha2(x, 256))), lambda x: x.isNotNull())
    out = base.withColumn("found", F.coalesce(found, F.array().cast("array<string>"))).join(small, "digest", "left")
    return out.select("doc_id", "canon_chars", "digest", "license",
                      F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
                      F.size("found").cast("long").alias("n_notices"))


def _scan_by_shuffle(base: DataFrame, digests: DataFrame, parts: Column) -> DataFrame:
    """The same rows for a table of licences that is too large to broadcast: plain joins on the digests of texts
    and of lines.  Lines are looked up once a distinct text, so copies cost nothing and no row needs an id."""
    known = digests.select(F.col("digest").alias("d"), F.col("license_id").alias("license"))
    lines = base.select("key", F.posexplode(F.transform(parts, lambda x: F.sha2(x, 256))).alias("i", "d")).distinct()
    notices = lines.join(known, "d").groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n_notices"))
    out = base.join(known, base["digest"] == known["d"], "left").join(notices, "key", "left")
    return out.select("doc_id", "canon_chars", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"),
                      F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql_respelled(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, ' {old.replace(' ', '  ')} ', '{f' {new} ' if new else '  '}')"
    return expr


def oracle_sql() -> str:
    """DuckDB SQL for ``license_scan(documents, known_texts())``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known_texts())
    lines = _sql_respelled(_sql_respelled("p", SPELLINGS), PHRASES)
    text = "trim(regexp_replace(" + _sql_respelled("regexp_replace(l, '[ \\n]+', '  ', 'g')", PHRASES) + ", ' +', ' ', 'g'))"
    return f"""
with known(license_id, text) as (values {known}),
both_ as (
  select 0 as kind, row_number() over () as rid, doc_id, null as license_id, text from documents
  union all select 1, 0, null, license_id, text from known),
padded as (
  select kind, rid, doc_id, license_id, '  ' || replace(regexp_replace(replace(regexp_replace(lower(coalesce(text, '')),
    {quoted(COPYRIGHT)}, '\\1\\4', 'g'), '&', ' and '), {quoted(BREAKS)}, '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  ' as p
  from both_),
lines as (select kind, rid, doc_id, license_id, {lines} as l from padded),
canon as (select *, {text} as c from lines),
digests as (
  select sha256(c) as digest, min(license_id) as license from canon where kind = 1 and c <> '' group by 1),
docs as (select rid, doc_id, l, length(c) as canon_chars, sha256(c) as digest from canon where kind = 0),
parts as (
  select rid, sha256(trim(regexp_replace(x, ' +', ' ', 'g'))) as digest
  from (select rid, unnest(string_split(l, chr(10))) as x from docs) where trim(x) <> ''),
hits as (
  select rid, string_agg(distinct license, ',' order by license) as notices, count(*) as n
  from parts join digests using (digest) group by rid)
select doc_id, canon_chars, docs.digest, license, coalesce(notices, '') as notices, cast(coalesce(n, 0) as bigint) as n_notices
from docs left join digests using (digest) left join hits using (rid)"""
