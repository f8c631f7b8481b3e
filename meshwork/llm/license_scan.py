"""License scans: texts compared with license templates by Dice's coefficient over word bigrams.

Units are the whole text, each of its lines and, for templates of ``LONG`` words or more, blocks: as many words as the
template has, from the start of any line of a text of several lines, so that a license wrapped anywhere within a longer document is met.
Normalisation lower-cases and turns everything but letters and digits into single spaces. The Dice coefficient
2 |A & B| / (|A| + |B|) of two bigram sets can reach t only if |A| lies between
t / (2 - t) |B| and (2 - t) / t |B|. Lines and texts with too few words, or too many different ones, for
all templates are dropped before any bigram is made, and a unit meets only the templates
within whose bounds it is. Blocks share at least t / (2 - t) |B| bigrams with their template; for each long template
there is a set of its words that more of its bigrams touch than may be missing, and a text without any of these
words has no blocks for it. All of it happens within a row; nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import table

THRESHOLD = 0.8
#: Words from which a template is compared with blocks.
LONG = 60

# Wording of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-text-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = _words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def markers(grams: list[str], most_missing: float) -> list[str]:
    """Words of which a unit must have one, as more than ``most_missing`` of the bigrams touch them: of long words, those of most bigrams first."""
    touched: set[str] = set()
    out: list[str] = []
    by_word: dict[str, set[str]] = {}
    for g in grams:
        for w in g.split():
            by_word.setdefault(w, set()).add(g)
    for w in sorted(by_word, key=lambda w: (len(w) < 6, -len(by_word[w]), w)):
        if len(touched) > most_missing:
            break
        touched |= by_word[w]
        out.append(w)
    return out


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_matches, license, dice, licenses).

    ``n_matches`` counts the lines and whole texts that reach the threshold with some template, each for its best, and the
    long templates that a block reaches it with, each once, by its best block.
    ``license`` and ``dice`` (six places) are the best of them (ties to the first
    name), ``licenses`` all names, sorted and joined by commas. A null or
    empty text has no units and so no match: zero, nulls and an empty string. Templates
    without a bigram match nothing. Repeated rows have a row each, an empty table none. Other columns are not read.
    """
    known = [(name, grams) for name, body in sorted((templates or TEMPLATES).items()) if (grams := bigrams_of(body))]
    if not known:
        raise ValueError("no template has two words")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(g) for _, g in known) * low, max(len(g) for _, g in known) * high
    if len(known) > 2000:
        raise ValueError("more templates than fit a plan")
    struct_of = lambda n, g: F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("grams"))
    table_of = F.array(*[struct_of(n, g) for n, g in known])
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("_lines", F.split("text", "\n"))
    # a text of one line is the line; short units can't have the bigrams, whatever their words are
    df = df.withColumn("_units", F.when(F.size("_lines") == 1, F.col("_lines")).otherwise(F.array_append("_lines", F.col("text"))))
    df = df.withColumn("_units", F.filter("_units", lambda u: F.char_length(u) > 2 * least))
    # a unit has as many bigrams as different words but one, or more
    df = df.withColumn("_words", F.filter(F.transform("_units", _words), lambda w: (F.size(w) - 1 >= least) & ((F.size(w) - 1 <= most) | (F.size(F.array_distinct(w)) - 1 <= most))))
    df = df.withColumn("_sets", F.filter(F.transform("_words", _grams), lambda s: F.size(s) >= least))

    def score(grams: Column, t: Column) -> Column:
        dice = 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))
        return F.struct((-dice).alias("minus"), t["name"].alias("name"))

    def best(grams: Column) -> Column:
        near = F.filter(table_of, lambda t: (F.size(grams) >= low * F.size(t["grams"])) & (F.size(grams) <= high * F.size(t["grams"])))
        return F.array_min(F.transform(near, lambda t: score(grams, t)))

    df = df.withColumn("_hits", F.filter(F.transform("_sets", best), lambda b: b["minus"] <= -threshold))
    long = [(n, g, len(_words_of(body))) for n, body in sorted((templates or TEMPLATES).items()) if (g := bigrams_of(body)) and len(_words_of(body)) >= LONG]
    if long:
        marks = sorted({w for _, g, _ in long for w in markers(g, len(g) * (1 - low))})
        df = df.withColumn("_lower", F.when(F.size("_lines") > 1, F.lower("text")).otherwise(F.lit("")))
        several = reduce(or_, [F.col("_lower").contains(w) for w in marks])
        df = df.withColumn("_by_line", F.when(several, F.transform("_lines", _words)).otherwise(F.expr("array()").cast("array<array<string>>")))
        df = df.withColumn("_all", F.flatten("_by_line"))
        df = df.withColumn("_known", F.when(F.size("_all") > 0, _grams(F.col("_all"))).otherwise(F.expr("array()").cast("array<string>")))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        put = lambda a, w: F.struct((a["at"] + F.size(w)).alias("at"), F.when(F.size(w) > 0, F.array_append(a["starts"], a["at"])).otherwise(a["starts"]).alias("starts"))
        df = df.withColumn("_starts", F.aggregate("_by_line", start, put)["starts"])

        def best_block(name: str, grams: list[str], n: int) -> Column:
            t = struct_of(name, grams)
            # where the last words of a text are fewer, the block is what there is
            blocks = F.transform(F.filter("_starts", lambda i: F.size("_all") - i >= n * low), lambda i: F.slice("_all", i + 1, n))
            # a text that lacks too many of the bigrams has no block that has them
            blocks = F.when(F.size(F.array_intersect("_known", t["grams"])) >= low * len(grams) - 1e-9, blocks).otherwise(F.expr("array()").cast("array<array<string>>"))
            return F.array_min(F.transform(blocks, lambda w: score(_grams(w), t)))

        found = [best_block(*x) for x in long]
        blocks = F.filter(F.array(*found), lambda b: b["minus"] <= -threshold)
        df = df.withColumn("_hits", F.concat("_hits", F.when(F.size("_starts") > 0, blocks).otherwise(F.expr("array()").cast("array<struct<minus: double, name: string>>"))))
    top = F.array_min("_hits")
    names = F.array_join(F.sort_array(F.array_distinct(F.transform("_hits", lambda b: b["name"]))), ",")
    return df.select("doc_id", F.size("_hits").cast("long").alias("n_matches"), top["name"].alias("license"), F.round(-top["minus"], 6).alias("dice"), names.alias("licenses"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle(threshold: float = THRESHOLD) -> str:
    values = ", ".join("('{}', ['{}'], {})".format(n, "', '".join(g), len(_words_of(b))) for n, b in sorted(TEMPLATES.items()) if (g := bigrams_of(b)))
    low = f"CAST({threshold / (2 - threshold)!r} AS DOUBLE)"
    return rf"""
WITH t(name, grams, n) AS (VALUES {values}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS nth, contains(text, chr(10)) AS several FROM d
), u AS (
  SELECT rid, unit FROM l UNION ALL SELECT rid, text FROM d WHERE contains(text, chr(10))
), w AS (
  SELECT row_number() OVER () AS uid, rid, regexp_extract_all(lower(unit), '[a-z0-9]+') AS words FROM u
), b AS (
  SELECT uid, rid, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) >= 2
), s AS (
  SELECT uid, rid, name, 2.0::DOUBLE * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice
  FROM b JOIN t ON len(b.grams) >= {low} * len(t.grams) AND len(b.grams) <= {(2 - threshold) / threshold!r} * len(t.grams)
), h AS (
  SELECT rid, name, dice FROM s WHERE dice >= {threshold!r} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, name) = 1
), lw AS (
  SELECT rid, nth, regexp_extract_all(lower(unit), '[a-z0-9]+') AS words FROM l WHERE several
), ls AS (
  SELECT rid, len(words) AS k, coalesce(sum(len(words)) OVER (PARTITION BY rid ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lw
), al AS (
  SELECT rid, flatten(list(words ORDER BY nth)) AS words FROM lw GROUP BY 1
), bw AS (
  SELECT rid, name, t.grams, list_slice(words, CAST(before AS BIGINT) + 1, CAST(before AS BIGINT) + n) AS words FROM ls JOIN al USING (rid) JOIN t ON n >= {LONG} AND len(words) - before >= n * {low} WHERE k > 0
), bs AS (
  SELECT rid, name, grams, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM bw
), bh AS (
  SELECT rid, name, max(2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams))) AS dice FROM bs GROUP BY 1, 2 HAVING dice >= {threshold!r}
), a AS (
  SELECT * FROM h UNION ALL SELECT * FROM bh
), g AS (
  SELECT rid, count(*) AS n, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM a GROUP BY 1
)
SELECT doc_id, coalesce(g.n, 0) AS n_matches, license, round(g.dice, 6) AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN g USING (rid)
"""


ORACLE_OP3 = _oracle()
