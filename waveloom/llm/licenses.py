"""Licence scans: passages against licence notices by the Dice coefficient over word bigrams, DataFrame operations only.

A text is normalised (lower case, letters and digits kept, the rest white space) and cut into passages: lines,
sentences within lines, those sentences of paragraphs that go over line ends, and whole paragraphs. A passage with a bigrams and a template with b bigrams can reach Dice d only if
d / (2 - d) * b <= a <= (2 - d) / d * b, so most templates are pruned by size before any bigram is compared, and passages that
fit no template by size never form bigrams.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

THRESHOLD = 0.8
#: Common licence notices and sentences of licence texts, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # whole sentences of licence texts and file headers
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    # paragraphs of whole licence texts
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """The fewest and most bigrams of a passage that can reach the threshold with a template of n bigrams."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9), math.floor((2 - threshold) / threshold * n + 1e-9)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _passage_bigrams(words: Column) -> Column:
    return _let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: n_matches, licenses (their identifiers, sorted, comma-joined), best (identifier or null), dice.

    A match is a passage whose best Dice reaches the threshold; ties between templates go to the first in their order,
    and the best passage is that of the largest Dice, then the first in the text. Null, empty and one-word texts have no
    passages with bigrams, so no matches: null best and dice 0. Texts are read whole, in one pass without a shuffle;
    repeated rows give repeated results; other columns are ignored.
    """
    table = [(name, grams, *size_bounds(len(grams), threshold)) for name, text in templates if (grams := bigrams(text))]
    low = min(t[2] for t in table)
    # the first cut is by words: n distinct bigrams need n + 1 words; the upper bounds hold for distinct bigrams only
    normal = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    def score(words):
        def best(b):
            options = [
                F.when(
                    F.size(b).between(lo, hi),
                    F.struct((2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, grams)))) / (F.size(b) + len(grams))).alias("dice"), F.lit(-k).alias("rank"), F.lit(name).alias("name")),
                )
                for k, (name, grams, lo, hi) in enumerate(table)
            ]
            return F.greatest(*options) if len(options) > 1 else options[0]

        return _let(_passage_bigrams(words), best)

    def scored(passage):
        own = _let(F.split(normal(passage), " "), lambda w: F.when(F.size(w) > low, score(w)))
        return _let(own, lambda s: F.when(s["dice"] >= threshold, s))

    def matches(sentence):
        """Of a sentence over line ends the whole counts, unless several of its lines match or one is nearer."""
        lines = F.filter(F.transform(F.split(sentence, "\n"), scored), lambda s: s.isNotNull())
        whole = F.when(F.contains(sentence, F.lit("\n")), scored(sentence))

        def choose(x):
            found, one = x["lines"], x["whole"]
            return F.when(one.isNotNull() & ((F.size(found) == 0) | (F.size(found) == 1) & (one["dice"] >= F.get(found, F.lit(0))["dice"])), F.array(one)).otherwise(found)

        return _let(F.struct(lines.alias("lines"), whole.alias("whole")), choose)

    def paragraph(p):
        """Of a paragraph of several sentences the whole counts, if it is at least as near as the nearest of them."""

        def choose(x):
            found, one = x["found"], x["one"]
            nearest = F.array_max(F.transform(found, lambda s: s["dice"]))
            return F.when(one.isNotNull() & (F.coalesce(nearest, F.lit(0.0)) <= one["dice"]), F.array(one)).otherwise(found)

        own = _let(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.struct(F.flatten(F.transform(s, matches)).alias("found"), F.when(F.size(s) > 1, scored(p)).alias("one")))
        return _let(own, choose)

    rows = docs.select("doc_id", text_of().alias("__t"))
    found = F.flatten(F.transform(F.split("__t", r"\r?\n[ \t]*\r?\n"), paragraph))
    lower = F.lower(F.col("__t"))
    hopeful = F.lit(False)
    plain, paired = mandatory(table, threshold)
    for word in plain:
        hopeful = hopeful | F.contains(lower, F.lit(word))
    if paired:
        hopeful = hopeful | lower.rlike("|".join(g.replace(" ", "[^a-z0-9]+") for g in paired))
    found = F.when(hopeful, found)
    none = F.array().cast("array<struct<dice:double,rank:int,name:string>>")
    rows = rows.select("doc_id", F.coalesce(found, none).alias("m"))
    best = F.aggregate("m", F.lit(None).cast("struct<dice:double,rank:int,name:string>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    rows = rows.select("doc_id", "m", best.alias("b"))
    return rows.select(
        "doc_id", F.size("m").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("m.name")), ",").alias("licenses"),
        F.col("b.name").alias("best"), F.coalesce("b.dice", F.lit(0.0)).alias("dice"),
    )


def mandatory(table, threshold: float) -> tuple[list[str], list[str]]:
    """Words, and bigrams of short words, of which every text with a match has one.

    A passage of Dice d shares at least d / (2 - d) of a template's bigrams, so it misses at most a few; of any larger set of its
    bigrams it has one, and so that one's longer word. The set with the longest words is taken for every template.
    """
    words: set[str] = set()
    pairs: set[str] = set()
    for _, grams, *_ in table:
        longest = {g: max(g.split(" "), key=lambda w: (len(w), w)) for g in grams}
        missing = math.floor(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
        for g in sorted(grams, key=lambda g: (-len(longest[g]), g))[: missing + 1]:
            if len(longest[g]) > 3:
                words.add(longest[g])
            else:
                pairs.add(g)
    # a word that holds another one is found with it
    return sorted(w for w in words if not any(o != w and o in w for o in words)), sorted(pairs)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(threshold: float = THRESHOLD) -> str:
    """The scan of `documents` as DuckDB SQL: every passage against every template of a fitting size."""
    table = []
    for k, (name, text) in enumerate(TEMPLATES):
        grams = bigrams(text)
        table.append(f"({k}, {_quoted(name)}, [{', '.join(map(_quoted, grams))}], {size_bounds(len(grams), threshold)[0]}, {size_bounds(len(grams), threshold)[1]})")
    return f"""
WITH tp(k, name, g, lo, hi) AS (VALUES {", ".join(table)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pa AS (SELECT r, generate_subscripts(l, 1) AS p, unnest(l) AS x FROM (SELECT r, string_split_regex(t, '\r?\n[ \t]*\r?\n') AS l FROM d)),
se AS (SELECT r, p, generate_subscripts(l, 1) AS s, unnest(l) AS x, len(l) AS n FROM (SELECT r, p, string_split(regexp_replace(x, '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM pa)),
li AS (SELECT r, p, s, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT r, p, s, string_split(x, chr(10)) AS l FROM se)),
ps AS (SELECT 'line' AS kind, r, p, s, i, x FROM li UNION ALL SELECT 'sentence', r, p, s, 0, x FROM se WHERE contains(x, chr(10)) UNION ALL SELECT DISTINCT 'paragraph', se.r, se.p, 0, 0, pa.x FROM se JOIN pa ON pa.r = se.r AND pa.p = se.p WHERE n > 1),
ws AS (SELECT kind, r, p, s, i, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM ps),
gr AS (SELECT kind, r, p, s, i, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS b FROM ws WHERE len(w) > 1),
sc AS (SELECT kind, r, p, s, i, k, name, 2::DOUBLE * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM gr JOIN tp ON len(b) BETWEEN lo AND hi),
bs AS (SELECT * FROM sc WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY kind, r, p, s, i ORDER BY dice DESC, k) = 1),
ln AS (SELECT *, count(*) OVER w AS n, max(dice) OVER w AS top FROM bs WHERE kind = 'line' WINDOW w AS (PARTITION BY r, p, s)),
so AS (SELECT b.* FROM bs b LEFT JOIN (SELECT DISTINCT r, p, s, n, top FROM ln) l USING (r, p, s) WHERE kind = 'sentence' AND (l.n IS NULL OR l.n = 1 AND b.dice >= l.top)),
sm AS (SELECT r, p, s, i, name, dice FROM ln WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.r = ln.r AND so.p = ln.p AND so.s = ln.s) UNION ALL SELECT r, p, s, i, name, dice FROM so),
po AS (SELECT b.* FROM bs b LEFT JOIN (SELECT r, p, max(dice) AS top FROM sm GROUP BY ALL) m USING (r, p) WHERE kind = 'paragraph' AND coalesce(m.top, 0) <= b.dice),
al AS (SELECT r, p, s, i, name, dice FROM sm WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.r = sm.r AND po.p = sm.p) UNION ALL SELECT r, p, s, i, name, dice FROM po),
ag AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses, arg_min(name, (-dice, p, s, i)) AS best, max(dice) AS dice FROM al GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best, coalesce(dice, 0)::DOUBLE AS dice FROM d LEFT JOIN ag USING (r)
"""


SQL = _sql()
