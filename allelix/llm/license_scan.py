"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are the lower-case runs of letters and digits; shingles are five words. Templates are grouped by their number of
shingles, and a text's shingles are cut into windows of one and a half times that number that overlap by at least the
whole template. A window that holds no shingle of any template can't share a band with one, so only windows around such
shingles are hashed; that loses nothing. With 64 bands of one hash each, a template of which 80 % lie in a window (similarity
at least 0.47) shares a band with it but for a chance under 1e-17. A candidate counts if the share of the template's shingles
that the window holds is at least the threshold. Only DataFrame and SQL functions run; texts aren't shuffled.

A template under five words is looked for by shingles of all its words, in a scan of its own.

Defined results: a null or blank text has no licenses; templates without a word are refused; a license that several windows hold is one row with the first best window; rows are told by number, so repeated rows, those with
equal or null ids too, give a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

#: Notices and opening or closing sentences of public licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-line": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "gpl-licensed-line": "licensed under the GNU General Public License",
    "lgpl-licensed-line": "licensed under the GNU Lesser General Public License",
    "agpl-licensed-line": "licensed under the GNU Affero General Public License",
    "bsd-2-clause-line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "all-rights-reserved-line": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Reproduction without written permission is prohibited. All rights reserved.",
}
#: Whole bodies of short public licenses, without their copyright lines.
_AS_IS = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
TEMPLATES |= {
    "mit": TEMPLATES["mit-grant"] + " " + TEMPLATES["mit-notice"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause": f"{_BSD} {_BSD_AS_IS} {_AS_IS}",
    "bsd-3-clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS} {_AS_IS}",
    "isc": TEMPLATES["isc-grant"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Identifiers of licenses in a source file's tag. Those of one word (four with the tag's own) would need a scan of all texts by four words.
TEMPLATES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0")}
K = 5


def _shingled(df: DataFrame, k: int) -> DataFrame:
    """Adds __s, the shingle hashes; null where there are fewer than k words."""
    df = df.withColumn("__w", F.filter(F.split(F.lower(F.col("__text")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    hashes = F.transform(F.sequence(F.lit(1), F.size("__w") - F.lit(k - 1)), lambda i: F.xxhash64(F.slice("__w", i, F.lit(k))))
    return df.withColumn("__s", F.when(F.size("__w") >= k, hashes)).drop("__w")


def _bands(values, bands: int):
    """One key per band: the least of the values under the band's hash function."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(values, lambda h: F.xxhash64(h, b))))


def _windows(m: int):
    """The windows for templates of m shingles that hold one of the hits; they start at multiples of half a template."""
    stride = max(1, m // 2)
    width = m + stride - 1

    def covering(hit):
        return F.sequence(F.greatest(F.lit(0), F.ceil((hit - (width - 1)) / stride)).cast("int"), F.floor(hit / stride).cast("int"))

    def window(s):
        grams = F.array_distinct(F.slice("__s", s * stride + 1, F.lit(width)))
        return F.struct(F.lit(m).alias("m"), (s * stride).alias("start"), grams.alias("grams"))

    return F.transform(F.array_distinct(F.flatten(F.transform("hits", covering))), window)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, k: int = K, bands: int = 64) -> DataFrame:
    """doc_id, license, containment, first_shingle (place of the best window), window_shingles; one row per row of docs and license."""
    templates = TEMPLATES if templates is None else templates
    by_k: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        by_k.setdefault(min(k, len([w for w in re.split(r"[\W_]+", text) if w])), {})[name] = text
    if 0 in by_k:
        raise ValueError(f"templates without words: {sorted(by_k[0])}")
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")))
    return reduce(DataFrame.unionByName, [_scan(rows, by_k[n], containment, n, bands) for n in sorted(by_k)])


def _scan(docs: DataFrame, templates: dict[str, str], containment: float, k: int, bands: int) -> DataFrame:
    spark = docs.sparkSession
    known = _shingled(spark.createDataFrame(list(templates.items()), "license string, __text string"), k)
    known = known.select("license", F.array_distinct("__s").alias("of"))
    listed = known.collect()  # a parameter, not data
    grams = sorted({h for r in listed for h in r["of"]})
    sizes = sorted({len(r["of"]) for r in listed})

    texts = _shingled(docs, k).drop("__text")
    hit = F.filter(F.transform("__s", lambda h, i: F.when(h.isin(grams), i)), lambda i: i.isNotNull())
    texts = texts.withColumn("hits", hit)
    # Without a filter here the shingles are made once; the table has them for texts with hits only.
    texts = materialize(texts.select("__row", "doc_id", F.when(F.size("hits") > 0, F.col("__s")).alias("__s"), "hits"), "shingles").where("__s is not null")
    cuts = texts.select("__row", "doc_id", "__s", F.array(*[_windows(m) for m in sizes]).alias("w"))
    cuts = materialize(cuts.select("__row", "doc_id", F.flatten("w").alias("w")), "windows").select("__row", "doc_id", F.explode("w").alias("w")).select("__row", "doc_id", "w.*")
    keyed = cuts.select("__row", "doc_id", "m", "start", "grams", F.posexplode(_bands(F.col("grams"), bands)).alias("band", "key"))
    wanted = known.select("license", "of", F.size("of").alias("m"), F.posexplode(_bands(F.col("of"), bands)).alias("band", "key"))
    met = keyed.join(F.broadcast(wanted), ["m", "band", "key"])  # a row for each band of each template, which are a parameter
    # A window that met a template in several bands is verified once; its bands are rows of one task, so they end there.
    met = met.groupBy("__row", "doc_id", "license", "start").agg(F.first("grams").alias("grams"), F.first("of").alias("of"))
    share = F.size(F.array_intersect("of", "grams")) / F.size("of")
    verified = met.select("__row", "doc_id", "license", "start", F.size("grams").alias("n"), share.alias("share")).where(F.col("share") >= containment)
    best = verified.groupBy("__row", "doc_id", "license").agg(F.max(F.struct("share", (-F.col("start")).alias("start"), "n")).alias("b"))
    return best.select("doc_id", "license", F.col("b.share").alias("containment"), (-F.col("b.start")).cast("long").alias("first_shingle"), F.col("b.n").cast("long").alias("window_shingles"))
