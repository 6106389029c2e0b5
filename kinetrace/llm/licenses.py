"""License scans: lines and whole texts against license templates by Dice over word bigrams.

A unit is a line or a whole text. Units and templates are normalised alike: A-Z to
lower case, everything but a-z and 0-9 to a space. With A and T the sets of word
bigrams, Dice is 2 |A and T| / (|A| + |T|). For Dice >= s it must hold that
|T| s / (2 - s) <= |A| <= |T| (2 - s) / s, so a template outside these bounds is never
compared, and a unit outside all bounds costs no comparison at all.

:func:`license_windows` takes every run of consecutive words as a unit instead, for notices
inside prose or longer documents.

The templates are a fixed array in the plan: no join, no shuffle, one pass.

Defined cases: null, empty and wordless texts have no license. Ties go to the license
that is first by name. Repeated rows are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
LEAST = Fraction(3, 4)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = f"""Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GNU = "This {0} redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {3} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {4} License for more details. You should have received a copy of the GNU {4} License along with this {3}. If not, see <https://www.gnu.org/licenses/>."

# Notices as the licences' own texts ask for them, or are commonly worded.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Full texts and file headers.
    ("AGPL-3.0", _GNU.format("program is free software: you can", "GNU Affero General Public License", "3", "program", "Affero General Public")),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("BSL-1.0", _BOOST),
    ("GPL-2.0", _GNU.format("program is free software; you can", "GNU General Public License", "2", "program", "General Public")),
    ("GPL-3.0", _GNU.format("program is free software: you can", "GNU General Public License", "3", "program", "General Public")),
    ("ISC", _ISC),
    ("LGPL-2.1", _GNU.format("library is free software; you can", "GNU Lesser General Public License", "2.1", "library", "Lesser General Public")),
    ("LGPL-3.0", _GNU.format("library is free software: you can", "GNU Lesser General Public License", "3", "library", "Lesser General Public")),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
)


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a normalised template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, least: Fraction = LEAST) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``least`` with a template of ``size``."""
    return -(-(size * least.numerator) // (2 * least.denominator - least.numerator)), size * (2 * least.denominator - least.numerator) // least.numerator


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: Fraction = LEAST) -> DataFrame:
    """Per document the best license, its Dice, the number of matching units and the best licenses of all units."""
    known = [(name, *bounds(len(b), least), b) for name, text in templates if (b := bigrams(text))]
    lowest, highest = min(k[1] for k in known), max(k[2] for k in known)
    table = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, b)).alias("grams")) for n, lo, hi, b in known])
    units = docs.select("doc_id", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("_lines")).select(
        "doc_id", F.expr("CASE WHEN size(_lines) = 1 THEN _lines ELSE array_append(_lines, array_join(_lines, ' ')) END").alias("_units")
    )
    words = F.transform("_units", lambda u: F.filter(F.split(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    worded = units.select("doc_id", F.filter(words, lambda w: F.size(w) > lowest).alias("_words"))
    grams = worded.select(
        "doc_id", F.expr("transform(_words, w -> array_distinct(transform(slice(w, 1, size(w) - 1), (x, i) -> concat(x, ' ', get(w, i + 1)))))").alias("_grams")
    )
    able = grams.select("doc_id", F.filter("_grams", lambda g: F.size(g).between(lowest, highest)).alias("_able"))
    found = able.select(
        "doc_id",
        F.when(
            F.size("_able") > 0,
            F.transform(
                "_able",
                lambda g: F.transform(
                    F.filter(table, lambda t: F.size(g).between(t["lo"], t["hi"])),
                    lambda t: F.struct((2 * F.size(F.array_intersect(g, t["grams"]))).cast("double").alias("shared") / (F.size(g) + F.size(t["grams"])), t["id"].alias("id")),
                ),
            ),
        ).alias("_scores"),
    )
    named = found.select("doc_id", F.transform(F.col("_scores"), lambda s: F.filter(F.transform(s, lambda x: F.struct((-x["col1"]).alias("cost"), x["id"].alias("id"))), lambda x: x["cost"] <= -float(least))).alias("_hits"))
    # of several templates that fit one unit, only the best stay
    named = named.withColumn("_hits", F.transform("_hits", lambda h: F.filter(h, lambda x: x["cost"] == F.array_min(h)["cost"])))
    hits = named.select("doc_id", F.coalesce(F.filter("_hits", lambda h: F.size(h) > 0), F.array()).alias("_units"), F.coalesce(F.flatten("_hits"), F.array()).alias("_hits"))
    best = F.array_min("_hits")
    return hits.select(
        "doc_id",
        best["id"].alias("license"),
        (-best["cost"]).alias("dice"),
        F.size("_units").cast("long").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["id"]))), ",").alias("licenses"),
    )


def license_windows(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: Fraction = LEAST) -> DataFrame:
    """Per document the best license over all runs of consecutive words, its Dice and all licenses found.

    A run's bigrams are at most the template's upper bound. Runs that begin and end with a bigram of the template
    are enough: without an outer bigram that the template lacks, Dice does not fall. A run needs the lower bound of
    shared bigrams, so documents that share fewer are left before any run is compared.
    """
    known = [(name, *bounds(len(b), least), b) for name, text in templates if (b := bigrams(text))]
    # one literal for each array: split is folded when the plan is made
    table = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.split(F.lit("|".join(b)), "[|]").alias("grams")) for n, lo, hi, b in known])
    every = F.split(F.lit("|".join(sorted({g for k in known for g in k[3]}))), "[|]")
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    grams = docs.select("doc_id", words.alias("_w")).select("doc_id", F.expr("transform(slice(_w, 1, greatest(size(_w) - 1, 0)), (x, i) -> concat(x, ' ', get(_w, i + 1)))").alias("_g"))
    shared = grams.select("doc_id", "_g", F.array_intersect("_g", every).alias("_s"))
    least_shared = min(k[1] for k in known)
    able = shared.select("doc_id", "_g", F.when(F.size("_s") >= least_shared, F.filter(table, lambda t: F.size(F.array_intersect(F.col("_s"), t["grams"])) >= t["lo"])).alias("_t"))
    # places of the template's bigrams, then the ends of each start
    at = able.select("doc_id", "_g", F.expr("transform(_t, t -> struct(t.id AS id, t.lo AS lo, t.hi AS hi, t.grams AS grams, filter(transform(_g, (g, i) -> if(array_contains(t.grams, g), i + 1, 0)), p -> p > 0) AS at))").alias("_t"))
    scored = at.select("doc_id", F.expr("""flatten(transform(_t, t -> transform(t.at, (p, i) -> struct(t.id AS id, coalesce(array_max(transform(
        filter(slice(t.at, i + t.lo, t.hi), q -> q - p < t.hi),
        q -> CAST(2 * size(array_intersect(slice(_g, p, q - p + 1), t.grams)) AS DOUBLE) / (size(array_distinct(slice(_g, p, q - p + 1))) + size(t.grams)))), 0D) AS dice))))""").alias("_x"))  # fmt: skip
    hits = scored.select("doc_id", F.coalesce(F.transform(F.filter("_x", lambda x: x["dice"] >= float(least)), lambda x: F.struct((-x["dice"]).alias("cost"), x["id"].alias("id"))), F.array()).alias("_hits"))
    best = F.array_min("_hits")
    return hits.select("doc_id", best["id"].alias("license"), (-best["cost"]).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["id"]))), ",").alias("licenses"))


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: Fraction = LEAST) -> str:
    """DuckDB SQL for the rows of :func:`license_scan` over ``documents``."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(x) for x in b)}])" for i, (name, text) in enumerate(templates) if (b := bigrams(text)))
    return f"""
WITH t(tid, id, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT rid, unnest(CASE WHEN len(l) = 1 THEN l ELSE list_append(l, array_to_string(l, ' ')) END) AS s FROM d),
w AS (SELECT rid, row_number() OVER () AS uid, list_filter(string_split(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT rid, uid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
s AS (SELECT rid, uid, id, CAST(2 * len(list_intersect(g, grams)) AS DOUBLE) / (len(g) + len(grams)) AS dice
      FROM g, t WHERE len(g) BETWEEN len(grams) // 4 AND len(grams) * 4),
h AS (SELECT * FROM s WHERE dice >= {float(least)} QUALIFY dice = max(dice) OVER (PARTITION BY uid)),
best AS (SELECT rid, id, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, id) AS k FROM h),
n AS (SELECT rid, count(DISTINCT uid) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM h GROUP BY rid)
SELECT doc_id, best.id AS license, best.dice AS dice, CAST(coalesce(n.n, 0) AS BIGINT) AS n_units, coalesce(n.ids, '') AS licenses
FROM d LEFT JOIN best ON best.rid = d.rid AND best.k = 1 LEFT JOIN n ON n.rid = d.rid"""
