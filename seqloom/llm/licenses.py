"""Licence scans by sentence rules, in SQL functions only: no Python, no shuffle, one pass over the text.

A text is cut at line ends, URLs and sentence marks into pieces, which are normalised (lower case,
letters and digits, years and names of holders dropped).  A run of whole pieces that together are a
known licence sentence of a fixed table is that sentence, the longest first: so lines may be wrapped
and commented, and marks inside a sentence ("free software: you can", "v. 2.0") do not hide it.  The identifiers
found, in text order, are matched against ordered rules: a rule is a run of identifiers and names
a licence; what a rule has matched is taken out before the next rule is tried.  Sentences that no
rule used are reported as such.

Null and empty texts have no sentence, and an empty table gives none.  Rows are scanned one by one, so repeated
rows, rows without an id and ties get equal results; of a licence found twice, the count says so; where two
runs match at one place the longer one wins.  A long text is held as a text a few times over, and only if it has a word
of a known sentence.  Other columns pass through ``scan``, whose own columns (sentence_ids, licenses, unused, n_known,
_low, _match) replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier -> normalised sentence (published licence texts and notices)
SENTENCES: dict[str, str] = {
    "ApacheNotice": "licensed under the apache license version 2 0",
    "ApacheNoticeThe": "licensed under the apache license version 2 0 the license",
    "ApacheMayNot": "you may not use this file except in compliance with the license",
    "ApacheObtain": "you may obtain a copy of the license at",
    "ApacheUnless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "SpdxApache": "spdx license identifier apache 2 0",
    "MitReleased": "released under the mit license",
    "MitLicensed": "licensed under the mit license",
    "MitTitle": "mit license",
    "MitTitleThe": "the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "SpdxMit": "spdx license identifier mit",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "IscAsIs": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BsdLicensed": "licensed under the bsd license",
    "SpdxBsd3": "spdx license identifier bsd 3 clause",
    "GplWork3": "this work is licensed under the gnu general public license version 3",
    "GplFree": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplFree2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "GplReceived": "you should have received a copy of the gnu general public license along with this program",
    "LgplWork": "this library is licensed under the gnu lesser general public license version 2 1",
    "AgplWork3": "this work is licensed under the gnu affero general public license version 3",
    "SpdxGpl3": "spdx license identifier gpl 3 0 or later",
    "MplForm": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MplObtain": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "EplNotice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "EplNoticeAt": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "SpdxEpl": "spdx license identifier epl 2 0",
    "CcByNc": "licensed under cc by nc 4 0",
    "CcBy": "licensed under cc by 4 0",
    "CcBySa": "licensed under cc by sa 4 0",
    "CcByWork": "this work is licensed under a creative commons attribution 4 0 international license",
    "CcBySaWork": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CcByNcWork": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "Cc0Waive": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "UnlicenseFree": "this is free and unencumbered software released into the public domain",
    "PublicDomain": "this work is in the public domain",
    "Reserved": "all rights reserved",
    "Copyright": "copyright",
    "Proprietary": "this document is proprietary and confidential",
}

#: Ordered rules, the longer runs first; each is a licence and its run of identifiers
RULES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "ApacheNoticeThe ApacheMayNot ApacheObtain ApacheUnless ApacheSee"),
    ("Apache-2.0", "ApacheNotice ApacheMayNot ApacheObtain ApacheUnless ApacheSee"),
    ("MIT", "MitTitle Copyright MitGrant MitNotice MitAsIs MitLiability"),
    ("MIT", "MitTitleThe Copyright MitGrant MitNotice MitAsIs MitLiability"),
    ("BSD-3-Clause", "Copyright Reserved BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs"),
    ("BSD-2-Clause", "Copyright Reserved BsdGrant BsdSource BsdBinary BsdAsIs"),
    ("BSD-3-Clause", "Copyright BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs"),
    ("BSD-2-Clause", "Copyright BsdGrant BsdSource BsdBinary BsdAsIs"),
    ("MIT", "Copyright MitGrant MitNotice MitAsIs MitLiability"),
    ("MIT", "MitTitle MitGrant MitNotice MitAsIs MitLiability"),
    ("MIT", "MitTitleThe MitGrant MitNotice MitAsIs MitLiability"),
    ("MIT", "MitGrant MitNotice MitAsIs MitLiability"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs"),
    ("GPL-3.0-or-later", "GplFree GplHope GplSee GplReceived"),
    ("GPL-2.0-or-later", "GplFree2 GplHope GplSee GplReceived"),
    ("GPL-3.0-or-later", "GplFree GplHope GplSee"),
    ("GPL-2.0-or-later", "GplFree2 GplHope GplSee"),
    ("ISC", "Copyright IscGrant IscAsIs"),
    ("ISC", "IscGrant IscAsIs"),
    ("MPL-2.0", "MplForm MplObtain"),
    ("MIT", "MitGrant MitNotice MitAsIs"),
    ("MPL-2.0", "MplForm"),
    ("EPL-2.0", "EplNoticeAt SpdxEpl"),
    ("EPL-2.0", "EplNoticeAt"),
    ("EPL-2.0", "EplNotice"),
    ("EPL-2.0", "SpdxEpl"),
    ("Apache-2.0", "ApacheNoticeThe"),
    ("Apache-2.0", "ApacheNotice"),
    ("Apache-2.0", "SpdxApache"),
    ("MIT", "MitReleased"),
    ("MIT", "MitLicensed"),
    ("MIT", "SpdxMit"),
    ("MIT", "MitTitleThe"),
    ("MIT", "MitTitle"),
    ("BSD", "BsdLicensed"),
    ("BSD-3-Clause", "SpdxBsd3"),
    ("GPL-3.0-only", "GplWork3"),
    ("GPL-3.0-or-later", "GplFree"),
    ("GPL-2.0-or-later", "GplFree2"),
    ("GPL-3.0-or-later", "SpdxGpl3"),
    ("LGPL-2.1-only", "LgplWork"),
    ("AGPL-3.0-only", "AgplWork3"),
    ("CC-BY-NC-4.0", "CcByNc"),
    ("CC-BY-4.0", "CcBy"),
    ("CC-BY-SA-4.0", "CcBySa"),
    ("CC-BY-4.0", "CcByWork"),
    ("CC-BY-SA-4.0", "CcBySaWork"),
    ("CC-BY-NC-4.0", "CcByNcWork"),
    ("CC0-1.0", "Cc0Waive"),
    ("Unlicense", "UnlicenseFree"),
    ("Public-Domain", "PublicDomain"),
    ("Proprietary", "Copyright Reserved"),
    ("Proprietary", "Reserved"),
    ("Proprietary", "Proprietary"),
)

#: of every known sentence, the words of one of these; texts without them are not normalised
ANCHORS = (("licen",), ("permi",), ("copyright",), ("warrant",), ("redistribut",), ("rights",), ("public", "domain"), ("mpl", "obtain", "distributed"), ("proprietary",))
#: a piece ends at a line's end, at a URL, or after one of these before a blank; what marks a line as a comment or an
#: item of a list is none of its words
_ENDS = r"https?://[^ \t\r\n]*|(?:^|[\r\n]+)(?:[ \t]*(?:rem|dnl)[ \t])?(?:[^a-z0-9\r\n]*[0-9a-z]\)[ \t])?|[.;:!?](?=[ \t]|$)"
#: the SQL looks up single sentences, one line each
_ENDS_DUCK = r"[\r\n]+|[.;:!?](?:[ \t]|$)"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _anchored(low: str) -> str:
    return "(" + " or ".join("(" + " and ".join(f"contains({low}, '{w}')" for w in a) + ")" for a in ANCHORS) + ")"


def scan(documents: DataFrame) -> DataFrame:
    """``documents`` with sentence_ids, licenses and unused, all arrays in text or rule order, and n_known."""
    if missing := {i for _, run in RULES for i in run.split()} - set(SENTENCES):
        raise ValueError(f"rules name unknown sentences: {missing}")
    if odd := [s for s in SENTENCES.values() if not any(all(w in s for w in a) for a in ANCHORS)]:
        raise ValueError(f"sentences without an anchor: {odd}")
    known = "map(" + ", ".join(f"{_q(s)}, '{i}'" for i, s in SENTENCES.items()) + ")"
    # pieces stand between bars; a sentence's blanks may be bars
    ends = f"regexp_replace(translate(_low, '|', ' '), {_q(_ENDS)}, '|')"
    pieces = f"regexp_replace(concat('|', regexp_replace({ends}, '[^a-z0-9|]+', ' '), '|'), '(?: *\\\\|)+ *', ' | ')"
    # "copyright (c) 2020 a holder" is the sentence "copyright"
    pieces = f"regexp_replace({pieces}, '(?<=\\\\| )copyright (c )?[0-9]{{4}}[^|]*(?= \\\\|)', 'copyright')"
    runs = "|".join(s.replace(" ", "(?: \\\\|)? ") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    cut = f"regexp_extract_all({pieces}, '(?<=\\\\| )(?:{runs})(?= \\\\|)', 0)"
    rules = "array(" + ", ".join(f"struct('{name}' as name, ' {' | '.join(run.split())} ' as run)" for name, run in RULES) + ")"
    # identifiers stand between bars, each with both of its own blanks, so that a run matches whole identifiers
    step = "if(contains(a.rest, r.run), named_struct('rest', replace(a.rest, r.run, ' # '), 'found', concat(a.found, array_repeat(r.name, cast((length(a.rest) - length(replace(a.rest, r.run, ''))) / length(r.run) as int)))), a)"
    out = documents.withColumn("_low", F.expr("lower(coalesce(text, ''))"))
    ids = f"transform({cut}, s -> element_at({known}, replace(s, ' |', '')))"
    out = out.withColumn("sentence_ids", F.expr(f"if({_anchored('_low')}, {ids}, cast(array() as array<string>))"))
    match = f"aggregate({rules}, named_struct('rest', concat(' ', array_join(sentence_ids, ' | '), ' '), 'found', cast(array() as array<string>)), (a, r) -> {step})"
    out = out.withColumn("_match", F.expr(f"if(size(sentence_ids) > 0, {match}, named_struct('rest', '', 'found', cast(array() as array<string>)))"))
    return out.withColumns(
        {
            "licenses": F.expr("_match.found"),
            "unused": F.expr("filter(split(_match.rest, ' \\\\| '), i -> trim(i) not in ('', '#'))"),
            "n_known": F.expr("cast(size(sentence_ids) as long)"),
        }
    ).drop("_low", "_match")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses, n_licenses, n_unused: lists joined by blanks."""
    return scan(documents).select("doc_id", "n_known", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), F.expr("cast(size(licenses) as long)").alias("n_licenses"), F.expr("cast(size(unused) as long)").alias("n_unused"))


def oracle() -> str:
    """The registered query in DuckDB."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    table = ", ".join(f"({q(s)}, '{i}')" for i, s in SENTENCES.items())
    sql = f"""with known(s, id) as (values {table}),
d as (select row_number() over () r, doc_id, lower(coalesce(text, '')) low from documents),
cut as (select r, generate_subscripts(a, 1) n, unnest(a) s from (select r, string_split_regex(low, '{_ENDS_DUCK}') a from d)),
norm as (select r, n, regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '^copyright (c )?[0-9]{{4}}.*$', 'copyright') s from cut),
ids as (select r, list(id order by n) ids from norm join known using (s) group by r),
m0 as (select r, ids, ' ' || array_to_string(ids, ' | ') || ' ' rest, '' found from ids)"""
    for k, (name, run) in enumerate(RULES, 1):
        run = f" {' | '.join(run.split())} "
        sql += f""",
m{k} as materialized (select r, ids, replace(rest, '{run}', ' # ') rest, found || repeat(' {name}', ((length(rest) - length(replace(rest, '{run}', ''))) // {len(run)})::int) found from m{k - 1})"""
    return sql + f"""
select doc_id, coalesce(len(ids), 0)::bigint n_known, coalesce(array_to_string(ids, ' '), '') sentence_ids, coalesce(trim(found), '') licenses,
  coalesce(len(list_filter(string_split(trim(found), ' '), lambda x: x <> '')), 0)::bigint n_licenses,
  coalesce(len(list_filter(string_split(rest, ' | '), lambda x: trim(x) not in ('', '#'))), 0)::bigint n_unused
from d left join m{len(RULES)} using (r)"""
