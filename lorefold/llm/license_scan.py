"""License scans by sentence rules: known licence sentences become identifiers, whose sequences match ordered licence rules. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

#: Known licence sentences, by identifier, as normalise() leaves them. Public licence texts.
SENTENCES: dict[str, str] = {
    "rights": "all rights reserved",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-work": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-work": "this work is licensed under the gnu affero general public license version 3",
    "apache-line": "licensed under the apache license version 2 0",
    "apache-use": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-line": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "bsd-is-provided": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-obtain-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-damages": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "boost-line": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "epl-line": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "apache-asf": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "apache-asf-grant": "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
}
#: Licences whose one-line SPDX tag is a known sentence too. SPDX identifiers.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
SENTENCES |= {f"spdx-{name.lower()}": "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ") for name in SPDX}
#: Licence rules: the licence, and the sentence identifiers that follow each other in its text.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("GPL-3.0", ("gpl3-work",)), ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-see")), ("GPL-3.0-or-later", ("gpl-redistribute",)), ("LGPL-3.0", ("lgpl-work",)), ("AGPL-3.0", ("agpl-work",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-see", "gpl-received")), ("GPL-2.0-or-later", ("gpl2-redistribute",)), ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-see")), ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-see", "gpl-received")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute",)), ("LGPL-2.1-or-later", ("lgpl-redistribute", "lgpl-hope", "lgpl-see")), ("AGPL-3.0-or-later", ("agpl-redistribute",)), ("AGPL-3.0-or-later", ("agpl-redistribute", "gpl-hope", "agpl-see")),
    ("Apache-2.0", ("apache-line",)), ("Apache-2.0", ("apache-use", "apache-copy", "apache-as-is", "apache-see")), ("Apache-2.0", ("apache-use",)), ("Apache-2.0", ("apache-asf", "apache-asf-grant")), ("Apache-2.0", ("apache-asf-grant", "apache-copy", "apache-as-is", "apache-see")),
    ("MIT", ("mit-line",)), ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")), ("MIT", ("mit-grant", "mit-notice")), ("BSL-1.0", ("boost-line",)), ("BSL-1.0", ("boost-grant",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-is-provided", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-is-provided", "bsd-liability")), ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-grant", "isc-as-is", "isc-liability")), ("MPL-2.0", ("mpl-line",)), ("MPL-2.0", ("mpl-line", "mpl-obtain")), ("MPL-2.0", ("mpl-line", "mpl-obtain-https")),
    ("Zlib", ("zlib-as-is", "zlib-damages", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")), ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered")), ("EPL-2.0", ("epl-line",)), ("WTFPL", ("wtfpl",)),
    ("CC-BY-4.0", ("cc-by",)), ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-ND-4.0", ("cc-by-nd",)), ("CC0-1.0", ("cc0",)), ("Unlicense", ("unlicense",)), ("Unlicense", ("unlicense", "unlicense-anyone")), ("proprietary", ("rights",)),
    ("CC-BY-4.0", ("cc-by-long",)), ("CC-BY-SA-4.0", ("cc-by-sa-long",)), ("CC-BY-NC-4.0", ("cc-by-nc-long",)), ("CC-BY-ND-4.0", ("cc-by-nd-long",)), *((name, (f"spdx-{name.lower()}",)) for name in SPDX),
]
#: Words of which each known sentence has one, so that most texts are ruled out by a few searches.
ANCHORS = ("license", "licensed", "software", "reserved", "copyright", "program", "redistributions", "redistribution", "contributors", "warranties", "advertising", "mpl", "notice", "altered")
#: Sentences that may stand between two of a rule (a copyright line, say).
GAP = 1
_END = r"([.!?])[\x20\x09-\x0D]+"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _unwrapped(marked: Column, known: Iterable[str]) -> Column:
    """Marked lines in which each known sentence that runs over several lines stands on one; longer sentences come first."""
    ordered = sorted(known, key=lambda s: (-len(s), s))
    if not ordered:
        return marked
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit("(?<![^NS])" + s.replace(" ", "[ N]") + "(?![^NS])").alias("wrapped")) for s in ordered])
    anchors = sorted({next((a for a in ANCHORS if a in s), s) for s in ordered})
    hopeful = lambda flat: reduce(lambda x, y: x | y, [F.contains(flat, F.lit(a)) for a in anchors])
    held = lambda t: _let(F.translate(t, "N", " "), lambda flat: F.when(hopeful(flat), F.filter(pairs, lambda k: F.contains(flat, k["s"]))))
    return _let(marked, lambda t: _let(held(t), lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.aggregate(found, t, lambda out, k: F.regexp_replace(out, k["wrapped"], k["s"]))).otherwise(t)))


def sentences(text: Column, known: Iterable[str] = ()) -> Column:
    """Normalised sentences of a text in order: lines, cut after . ! or ? before white space; words of a-z and 0-9 joined by blanks; empty ones dropped.

    A known sentence that is wrapped over consecutive lines, with or without comment leaders, is one sentence.
    """
    marked = F.translate(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _END, "S"), "\n", "N")  # no other capitals are left
    marked = F.trim(F.regexp_replace(marked, "[^a-z0-9NS]+", " "))
    marked = F.regexp_replace(F.regexp_replace(marked, "[ N]*S[ NS]*", "S"), " ?N[ N]*", "N")
    return F.filter(F.split(_unwrapped(marked, known), "[NS]"), lambda s: s != "")


def _literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _matches(ids: Column, at: Column, rules: Sequence[tuple[str, Sequence[str]]], gap: int) -> Column:
    """Places where the identifiers are those of a rule, in its order, with no more than `gap` other sentences between two."""
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), _literal(parts).alias("parts"), F.lit(len(parts)).alias("n")) for licence, parts in rules])
    numbers = lambda low, high: F.when(high >= low, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<int>"))
    near = lambda i, n: F.forall(numbers(i, i + n - 2), lambda k: F.element_at(at, k + 1) - F.element_at(at, k) <= gap + 1)
    starts = lambda r: F.filter(numbers(F.lit(1), F.size(ids) - r["n"] + 1), lambda i: (F.slice(ids, i, r["n"]) == r["parts"]) & near(i, r["n"]))
    place = lambda r, i: F.struct(r["licence"].alias("licence"), F.element_at(at, i).alias("first"), F.element_at(at, i + r["n"] - 1).alias("last"), r["n"].alias("parts"))
    return F.flatten(F.transform(table, lambda r: F.transform(starts(r), lambda i: place(r, i))))


def scan(docs: DataFrame, known: Mapping[str, str] | None = None, rules: Sequence[tuple[str, Sequence[str]]] | None = None, gap: int = GAP) -> DataFrame:
    """docs (doc_id, text, ...) with n_sentences, recognised (position, id) in order, and matches (licence, first, last sentence, parts).

    A rule matches recognised sentences that follow each other in its order, with at most `gap` other sentences between two; of overlapping matches those
    inside a longer one are dropped, and a match of each rule counts wherever it occurs. A null, empty or unrecognised text has empty lists.
    A known sentence may be wrapped over lines, with or without comment leaders. Texts are read whole, however long.
    Repeated rows are scanned alike, further columns pass through, and columns with the names of the results are replaced.

    One projection does it all, so nothing is shuffled or broadcast, and no group of rows can be hot. Lists are as long as a text has sentences.
    """
    known, rules = known or SENTENCES, rules or RULES
    by_text = F.map_from_arrays(_literal(list(known.values())), _literal(list(known)))
    rest = docs.drop("n_sentences", "recognised", "matches")
    split = rest.withColumn("_sentences", sentences(F.col("text"), known.values()))
    placed = F.filter(F.transform("_sentences", lambda s, i: F.struct(i.alias("position"), s.alias("s"))), lambda x: F.array_contains("_known", x["s"]))
    split = split.withColumn("_known", F.array_intersect("_sentences", _literal(list(known.values()))))
    ids = F.transform(F.when(F.size("_known") > 0, placed).otherwise(F.filter(placed, lambda x: F.lit(False))), lambda x: F.struct(x["position"].alias("position"), F.element_at(by_text, x["s"]).alias("id")))
    found = split.withColumn("n_sentences", F.size("_sentences").cast("long")).withColumn("recognised", ids).drop("_sentences", "_known")
    matches = _matches(F.col("recognised.id"), F.col("recognised.position"), rules, gap)
    none = F.array().cast("array<struct<licence:string,first:int,last:int,parts:int>>")
    every = found.withColumn("_all", F.when(F.size("recognised") > 0, matches).otherwise(none))
    inside = lambda m: F.exists("_all", lambda o: (o["parts"] > m["parts"]) & (o["first"] <= m["first"]) & (o["last"] >= m["last"]))
    return every.withColumn("matches", F.array_sort(F.filter("_all", lambda m: ~inside(m)))).drop("_all")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_sentences", F.size("recognised").cast("long").alias("n_recognised"), F.array_join(F.col("recognised.id"), ",").alias("sentence_ids"),
        F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",").alias("licences"),
    )


def _sql() -> str:
    quoted = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    whole = "t"
    for s in sorted(SENTENCES.values(), key=lambda s: (-len(s), s)):  # line ends are doubled, so that neighbours don't share one
        whole = f"regexp_replace({whole}, '(^|[NS]){s.replace(' ', '(?: |NN)')}([NS]|$)', '\\1{s}\\2', 'g')"
    rules = ", ".join(f"({k}, '{licence}', {quoted(parts)})" for k, (licence, parts) in enumerate(RULES))
    return rf"""
with marked as (select doc_id, trim(regexp_replace(translate(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_END}', 'S', 'g'), chr(10), 'N'), '[^a-z0-9NS]+', ' ', 'g')) as t from documents),
doubled as (select doc_id, replace(replace(regexp_replace(regexp_replace(t, '[ N]*S[ NS]*', 'S', 'g'), ' ?N[ N]*', 'N', 'g'), 'N', 'NN'), 'S', 'SS') as t from marked),
cut as (select doc_id, list_filter(string_split_regex({whole}, '[NS]+'), lambda s: s <> '') as s from doubled),
known as (select unnest({quoted(SENTENCES.values())}) as s, unnest({quoted(SENTENCES)}) as id),
found as (select doc_id, list(id order by p) as ids, list(p order by p) as ps from (select doc_id, unnest(s) as s, unnest(range(len(s))) as p from cut) join known using (s) group by doc_id),
rules as (select * from (values {rules}) as r(rule, licence, parts)),
places as (select doc_id, licence, len(parts) as n, i, ps, ids[i:i + len(parts) - 1] as here, parts from (select *, unnest(range(1, len(ids) - len(parts) + 2)) as i from found, rules where len(ids) >= len(parts))),
matches as (select doc_id, licence, n, ps[i] as low, ps[i + n - 1] as high from places where here = parts and len(list_filter(range(i, i + n - 1), lambda k: ps[k + 1] - ps[k] > {GAP + 1})) = 0),
kept as (select doc_id, count(*) as n_matches, string_agg(distinct licence, ',' order by licence) as licences from matches m
   where not exists (select 1 from matches o where o.doc_id = m.doc_id and o.n > m.n and o.low <= m.low and o.high >= m.high) group by doc_id)
select doc_id, len(cut.s)::bigint as n_sentences, coalesce(len(ids), 0)::bigint as n_recognised, coalesce(array_to_string(ids, ','), '') as sentence_ids,
   coalesce(n_matches, 0)::bigint as n_matches, coalesce(licences, '') as licences
from cut left join found using (doc_id) left join kept using (doc_id)"""


SQL = {"op7_license_scan": _sql()}
