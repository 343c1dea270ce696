"""Licence scans, with DataFrame operations only.

Templates are notices by which licences call themselves and whole licence texts; they are a parameter.  Files and templates are cut into
sentences in the same way (line breaks within a paragraph are spaces, so wrapped licence files read as they were written).  A sentence
speaks of a licence if it holds one of the ``MARKS``, words that tell families of licences apart; such sentences are a file's header.
Template sentences without a mark, such as disclaimers that several licences share, decide nothing and are left out.

A sentence is judged by its ``fit``: the best cosine of TF-IDF vectors between a template sentence and a window of as many words (the whole
sentence where that is shorter) in which a mark stands where the template has it, give or take ``SLACK`` words.  So words before and after
do not count, and a window always holds a mark of the family: "the XYZ License" is not MIT.  Document frequencies are those of every header
word, over all files.  The best fit decides a file's own licence; where licences share sentences, the one with more of them in the file.

``score`` is another, stricter figure: the cosine of the best of those sentences as a whole, in which a word that no template has weighs
as much as a word seen in no header.  It falls with every extra word and decides nothing.

A file whose header makes up at least a fifth of its words is a licence file of its directory.  Files without an own licence take that of
the nearest ancestor directory that has a licence file, found by joins of directory paths.

Scale: texts are read once and not shuffled.  A sentence or a directory that a third of all files share is scored once; directories
join back to files under a salt, and nothing above the join of sentences needs a key together, so Spark can split it.  Template tables are
broadcast; their size is that of the templates.  A very long sentence makes a few windows for each mark in it, not for each word.

Defined cases: a null or empty text has no header and no licence; a null path is the root; equal fits of as many sentences go to the licence that comes
first by name, equal licence files to the smaller path; rows are judged each by its own text, also without an id or with the id and path of
another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Names by which public licences call themselves in headers.
NOTICES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved.", "Copyright, all rights reserved, no part may be reproduced without permission."],
    "Unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
}
#: Whole texts of short licences, and the notices that long ones ask to be put at the head of a file.
TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.""",
}
#: Notices and whole texts of each licence.
TEMPLATES = {name: [*xs, *([TEXTS[name]] if name in TEXTS else [])] for name, xs in NOTICES.items()}
#: Words that tell families of licences apart.
MARKS = {
    "AGPL": ["affero", "agpl"], "Apache": ["apache"], "BSD": ["bsd", "redistribution", "redistributions", "endorse"], "CC": ["cc", "creative", "cc0"], "GPL": ["gnu", "gpl"], "ISC": ["isc", "fee"],
    "LGPL": ["lesser", "lgpl"], "MIT": ["mit", "sublicense", "charge", "noninfringement"], "MPL": ["mozilla", "mpl"], "Proprietary": ["reserved"], "Unlicense": ["unlicense", "unencumbered"], "Zlib": ["zlib", "misrepresented"],
}
#: How far from its place in the template a mark may stand in a window.
SLACK = 2
#: Copies of a directory's row, so that the files of a hot one meet it in several tasks.
SALTS = 16
WORDS = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"


#: Where a text is cut into sentences.
BREAK = r"(?<=[.!?])\s+|\n[ \t]*\n\s*"


def _tokens(c):
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORDS})"), F.lit(1))


def family(name: str) -> str:
    """A licence's name up to its version or variant."""
    return re.split(r"\d|-", name)[0]


def _words(texts: list[str]) -> set[str]:
    return {w for t in texts for w in re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower())}


def marks_of(templates: dict[str, list[str]]) -> dict[str, set[str]]:
    """family -> words that tell it apart: those of ``MARKS``, else the words of its templates that no other family's have, known ones included.

    A family without such a word is told by all its words.
    """
    own: dict[str, set[str]] = {}
    for name, texts in [*TEMPLATES.items(), *templates.items()]:
        own.setdefault(family(name), set()).update(_words(texts))
    out = {}
    for f in {family(n) for n in templates}:
        others = set().union(*(ws for g, ws in own.items() if g != f))
        out[f] = set(MARKS.get(f, ())) or own[f] - others or own[f]
    return out


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, int, int, int, str, bool]]:
    """name, sentence, its length, position, word, whether it is a mark: of template sentences that have a mark."""
    out, told = [], marks_of(templates)
    for name, texts in sorted(templates.items()):
        marks = told[family(name)]
        for i, x in enumerate(x for t in texts for x in re.split(BREAK, t)):
            ws = re.findall(r"[^\W_]+(?:\.[0-9]+)*", x.lower())
            if marks & set(ws):
                out += [(name, i, len(ws), pos, w, w in marks) for pos, w in enumerate(ws)]
    return out


def fits(sentences: DataFrame, terms: DataFrame, weighed: DataFrame, places: DataFrame, total: DataFrame) -> DataFrame:
    """sid, name, fit: how well a licence's templates fit a window of the sentence at best.  ``places``: positions of marks."""
    df = terms.groupBy("w").agg(F.sum("n").alias("df"))
    told = sentences.select("sid", F.size(_tokens(F.col("s"))).alias("len"), _tokens(F.col("s")).alias("ws"))  # sizes first: no row carries its sentence
    said = told.select("sid", "len", F.posexplode("ws").alias("pos", "w"))
    said = materialize(said.join(df, "w").join(F.broadcast(total)).select("sid", "len", "pos", "w", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("x")))
    last = F.greatest(F.col("len") - F.col("long"), F.lit(0))
    near = F.transform(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda d: F.least(F.greatest(F.col("pos") - F.col("at") + d, F.lit(0)), last))
    # marks only: a few windows for each in a sentence
    windows = said.join(F.broadcast(places.select("w", "name", "i", "long", "at")), "w").select("sid", "name", "i", "long", F.explode(F.array_distinct(near)).alias("start")).distinct()
    window = ["sid", "name", "i", "start"]
    words = windows.select(*window, F.explode(F.sequence("start", (F.col("start") + F.col("long") - 1).cast("int"))).alias("pos")).join(said.select("sid", "pos", "w", "x"), ["sid", "pos"])
    u = F.broadcast(weighed.select("name", "i", "w", (F.col("tw") / F.col("norm")).alias("u")))
    words = words.groupBy(*window, "w").agg((F.count(F.lit(1)) * F.first("x")).alias("x")).join(u, ["name", "i", "w"], "left")
    each = words.groupBy(*window).agg(F.round(F.sum(F.col("x") * F.coalesce("u", F.lit(0.0))) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 9).alias("fit"))
    return each.groupBy("sid", "name").agg(F.max("fit").alias("fit"))


def scan(
    files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text",
    least: float = 0.6, share: float = 0.2, templates: dict[str, list[str]] | None = None,
) -> DataFrame:
    """key, path, own_licence, score, inherited_licence, inherited_from, licence."""
    spark = files.sparkSession
    known_words = template_words(templates or TEMPLATES)
    marks = sorted({w for *_, w, mark in known_words if mark})
    lines = F.split(F.coalesce(F.col(text), F.lit("")), BREAK)
    head = F.filter(lines, lambda s: s.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, marks))})(?![\p{{L}}\p{{N}}])"))
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    narrow = files.select(F.col(key).alias("id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.array_distinct(F.transform(head, lambda s: F.trim(s))).alias("head"), (words(F.array_join(head, " ")) >= share * words(F.coalesce(F.col(text), F.lit("")))).alias("mostly"))
    narrow = materialize(narrow.withColumns({"row": F.monotonically_increasing_id(), "dir": F.regexp_replace("path", r"/?[^/]*$", ""), "mostly": F.col("mostly") & (F.size("head") > 0)}))
    said = narrow.where(F.size("head") > 0).select("row", F.explode("head").alias("s"))
    sentences = materialize(said.groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("sid", F.monotonically_increasing_id()))
    terms = sentences.select("sid", "n", F.explode(_tokens(F.col("s"))).alias("w")).groupBy("sid", "n", "w").agg(F.count(F.lit(1)).alias("tf"))

    # rows fixed by the templates
    t = materialize(spark.createDataFrame(known_words, "name string, i int, long int, at int, w string, mark boolean"))
    places = t.where("mark")
    t = t.groupBy("name", "i", "w").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = F.broadcast(t.select("w").distinct())
    df = terms.join(vocabulary, "w").groupBy("w").agg(F.sum("n").alias("df"))
    total = sentences.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    idf = lambda: F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = t.join(F.broadcast(df), "w", "left").join(F.broadcast(total)).select("name", "i", "w", "tf", (F.col("tf") * idf()).alias("tw"), idf().alias("idf"))
    weighed = materialize(weighed.withColumn("norm", F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(Window.partitionBy("name", "i")))))
    by_word = weighed.groupBy("w").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("name", "i", (F.col("tw") / F.col("norm")).alias("u"))).alias("us"))
    known = terms.join(F.broadcast(by_word), "w", "left").join(F.broadcast(total))
    known = known.withColumn("x", F.col("tf") * F.coalesce("idf", F.log(F.col("total") + 1) + 1))
    size = known.groupBy("sid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = known.where("us is not null").select("sid", "x", F.explode("us").alias("u")).groupBy("sid", "u.name", "u.i").agg(F.sum(F.col("x") * F.col("u.u")).alias("dot"))
    best = dots.join(size, "sid").groupBy("sid").agg(F.max(F.round(F.col("dot") / F.col("size"), 9)).alias("score"))
    judged = fits(sentences, terms, weighed, places, total).where(F.col("fit") >= least).join(best, "sid")

    judged = materialize(sentences.select("sid", "s").join(judged, "sid").select("s", "name", "fit", "score"))
    each = said.join(judged, "s").groupBy("row", "name").agg((-F.max("fit")).alias("m"), (-F.count(F.lit(1))).alias("k"), F.max("score").alias("score"))
    own = each.groupBy("row").agg(F.min(F.struct("m", "k", "name")).alias("o"), F.max("score").alias("score"))
    own = own.select("row", F.col("o.name").alias("own_licence"), "o.m", "score")
    own = materialize(narrow.select("row", "id", "path", "dir", "mostly").join(own, "row", "left"))
    # one licence file for each directory that has any
    licensed = own.where("mostly and own_licence is not null").groupBy("dir").agg(F.min(F.struct("m", "path", "own_licence")).alias("l")).select("dir", F.col("l.own_licence").alias("inherited_licence"))
    dirs = own.select("dir").distinct()
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    up = dirs.withColumn("parts", parts).select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice("parts", 1, d), "/").alias("a")))).alias("u"))
    near = up.join(licensed.withColumnRenamed("dir", "a0").hint("merge"), F.col("u.a") == F.col("a0")).groupBy("dir").agg(F.max(F.struct(F.col("u.depth").alias("depth"), F.col("a0").alias("inherited_from"), "inherited_licence")).alias("b"))
    near = near.select("dir", "b.inherited_licence", "b.inherited_from")
    near = near.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    out = own.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(near, ["dir", "salt"], "left")
    takes = F.col("own_licence").isNull()
    return out.select(
        F.col("id").alias(key), "path", "own_licence", "score", F.when(takes, F.col("inherited_licence")).alias("inherited_licence"), F.when(takes, F.col("inherited_from")).alias("inherited_from"), F.coalesce("own_licence", "inherited_licence").alias("licence")
    )
