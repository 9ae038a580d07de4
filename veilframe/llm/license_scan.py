"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, text_of

#: Titles and notices of public licences (fixed values).
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Simplified BSD License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
#: Words that may state a licence (over line ends and comment marks), names of licence files, marks of comment lines, terms.
NOTICE = re.compile(r"licen[cs]e|copyright|spdx|creative[\s#*/;]+commons|public[\s#*/;]+domain|redistribution|permission[\s#*/;]+(?:is[\s#*/;]+hereby|to[\s#*/;]+use)|free[\s#*/;]+software", re.IGNORECASE)
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$"
COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|<!--)")
TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)?", re.IGNORECASE | re.ASCII)
#: Least cosine of a match of a whole header or licence file, and of a window of a template's length.
LEAST_COSINE, WINDOW_COSINE = 0.6, 0.8
#: Least share of a window's terms that its template must hold for the window to be compared; terms of a text that are looked at together.
WINDOW_SHARE, STRETCH = 0.6, 20_000
#: A term is frequent if it occurs in more than one of so many passages; rows of a table up to which it is broadcast; parts of hot directories.
RARE, FEW, SALTS = 1000, 20_000, 16


def terms(text: str) -> list[str]:
    return [t.lower() for t in TERM.findall(text)]


_TEMPLATES = [(name, terms(text)) for name, texts in TEMPLATES.items() for text in texts]
_LENGTHS = [len(t) for _, t in _TEMPLATES]
#: Numbers of the templates' terms, and which templates hold each; the last row is for any other term.
_NUMBERS = {t: k for k, t in enumerate(sorted({t for _, words in _TEMPLATES for t in words}))}
_HOLDS = np.array([[t in words for words in [set(w) for _, w in _TEMPLATES]] for t in sorted(_NUMBERS)] + [[False] * len(_TEMPLATES)], np.int32)


def headers(text: str) -> list[str]:
    """Maximal runs of lines that are comments or may state a licence, those that do."""
    lines = text.split("\n")
    part = [bool(NOTICE.search(x) or COMMENT.match(x)) for x in lines]
    runs = ["\n".join(lines[k] for k, _ in run) for on, run in itertools.groupby(enumerate(part), key=lambda x: x[1]) if on]
    return [r for r in runs if NOTICE.search(r)]


def windows(text: str) -> set[str]:
    """For each place that may state a licence and each template, the window of the template's length around it that shares most terms, if many; of equal ones the first.

    Windows are runs of terms, so blanks, line ends and comment marks between them take no room.  Which templates hold a term is looked up once a term; shares are differences of running sums.
    """
    spots = [m.start() for m in NOTICE.finditer(text)]
    found = [(x.end(), x[0].lower()) for x in TERM.finditer(text)] if spots else []
    if not found:
        return set()
    words, longest = [t for _, t in found], max(_LENGTHS)
    at = np.unique(np.minimum(np.searchsorted([e for e, _ in found], spots, side="right"), len(words) - 1))
    out: set[str] = set()
    while len(at):
        low = max(0, int(at[0]) - longest)
        some = at[at < low + STRETCH]
        at = at[len(some) :]
        part = words[low : int(some[-1]) + longest]
        held = np.concatenate([np.zeros((1, len(_LENGTHS)), np.int32), np.cumsum(_HOLDS[[_NUMBERS.get(t, -1) for t in part]], axis=0, dtype=np.int32)])
        for k, n in enumerate(_LENGTHS):
            size = min(n, len(part))
            starts = np.clip(some[:, None] - low - n + 1 + np.arange(n), 0, len(part) - size)
            shared = held[starts + size, k] - held[starts, k]
            best = shared.argmax(axis=1)
            rows = np.arange(len(some))
            for start in np.unique(starts[rows, best][shared[rows, best] >= WINDOW_SHARE * size]).tolist():
                out.add(" ".join(part[start : start + size]))
    return out


def passages(path: str | None, text: str) -> list[tuple[str, bool]]:
    """Terms of what is compared: the whole text of a licence file, else each header, and windows (marked true)."""
    if not NOTICE.search(text) and not (path and re.search(LICENSE_FILE, path)):
        return []
    whole = [text] if path and re.search(LICENSE_FILE, path) else headers(text)
    return sorted({(" ".join(terms(x)), False) for x in whole} | {(x, True) for x in windows(text)})


def noticed(files: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """``path, row, parts``: for each file its :func:`passages` as ``terms, window``, and its ``carried`` columns as one struct."""
    kind = pa.list_(pa.struct([("terms", pa.string()), ("window", pa.bool_())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)
        parts = [[{"terms": t, "window": w} for t, w in passages(path, text)] for path, text in texts]
        return pa.RecordBatch.from_arrays([batch.column("path"), batch.column("row"), pa.array(parts, kind)], ["path", "row", "parts"])

    given = files.select(F.col("path").cast("string").alias("path"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("row"), text_of().alias("text"))
    return map_arrow(given, work, f"path string, row {given.schema['row'].dataType.simpleString()}, parts array<struct<terms:string,window:boolean>>")


def similarities(texts: DataFrame) -> DataFrame:
    """``id, license, cosine``: nearest template of each distinct passage of ``id, terms`` with a cosine of at least ``LEAST_COSINE``.

    Sparse TF-IDF vectors as rows of ``id, term, tf``; document frequencies of all terms, over all distinct passages and the templates.
    A frequent term's weight is broadcast (their number is bounded by passages' mean length times ``RARE``), a rare term's is joined.
    """
    spark = texts.sparkSession
    known = spark.createDataFrame([(f"template {k}", " ".join(t)) for k, (_, t) in enumerate(_TEMPLATES)], "id string, terms string")
    rows = stored(texts.unionByName(known).select("id", F.explode(F.split("terms", " ")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")), "terms")
    n = texts.count() + len(_TEMPLATES)
    weight = (1 + F.log((1 + F.lit(n)) / (1 + F.col("df")))).alias("idf")
    frequency = stored(rows.groupBy("term").agg(F.count("*").alias("df")), "term-frequency")
    often = F.col("df") * RARE > n
    hot = F.broadcast(frequency.where(often).select("term", weight))
    weighed = rows.join(hot, "term").unionByName(rows.join(hot, "term", "left_anti").join(frequency.where(~often).select("term", weight), "term"))
    vectors = stored(weighed.select("id", "term", (F.col("tf") * F.col("idf")).alias("w")), "term-weights")
    norms = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template = F.col("id").startswith("template ")
    # as many rows as the templates have terms
    other = vectors.where(template).select(F.substring("id", 10, 9).cast("int").alias("k"), "term", F.col("w").alias("t"))
    lengths = norms.where(template).select(F.substring("id", 10, 9).cast("int").alias("k"), F.col("norm").alias("t_norm"))
    dots = vectors.where(~template).join(F.broadcast(other), "term").groupBy("id", "k").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    cosines = dots.join(norms, "id").join(F.broadcast(lengths), "k").select("id", "k", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
    best = cosines.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("k")).alias("first"))).alias("b")).where(F.col("b.cosine") >= LEAST_COSINE)
    name = F.element_at(F.array(*[F.lit(x) for x, _ in _TEMPLATES]), (1 - F.col("b.first")).cast("int"))
    return best.select("id", name.alias("license"), F.col("b.cosine").alias("cosine"))


def _above(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def nearest(dirs: DataFrame, sources: DataFrame) -> DataFrame:
    """``dir, from``: the licence file in a directory itself, else in its nearest ancestor.

    ``dirs``: distinct ``dir``; ``sources``: ``dir, from``, one row each.  A directory's own file is found by an equal path.  Of the others only the
    distinct parents are joined with all their ancestors; so a directory with very many below it is one row in that join.
    """
    direct = stored(dirs.join(sources, "dir"), "own-directories")
    open_ = dirs.join(direct, "dir", "left_anti").select("dir", _above(F.when(F.col("dir") != "", F.col("dir"))).alias("up"))
    parts = F.split("up", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    parents = open_.select("up").where("up IS NOT NULL").distinct().select("up", F.explode(chain).alias("a")).select("up", "a.depth", "a.dir")
    found = stored(parents.join(sources, "dir").groupBy("up").agg(F.max_by("from", "depth").alias("from")), "ancestors")
    if found.count() <= FEW:
        far = open_.join(F.broadcast(found), "up")
    else:
        part = F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int")
        far = open_.withColumn("part", part).join(found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["up", "part"])
    return direct.unionByName(far.select("dir", "from"))


def scan(files: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Licences of files, their own or inherited.

    Headers (runs of comment and notice lines), whole licence files and windows of the templates' lengths around each place that may state a
    licence become sparse TF-IDF vectors, distinct ones once; the nearest template by exact cosine is the licence, from 0.6 for headers and
    files and from 0.8 for windows (notices inside long or wrapped lines).  A file without one takes the licence of the licence file
    (``LICENSE``, ``COPYING`` and the like) in its nearest ancestor directory, by joins of paths.

    ``files`` has ``path, text``.  Returns ``path, own_license, similarity, license, inherited_from`` and the ``carried`` columns, one row for each row of
    ``files``; repeated rows stay repeated.  A null text has no notices; a null path inherits nothing; of several licence files in a
    directory the first by name counts; ties between templates go to the first by table order; an empty table gives an empty
    result; further columns are ignored.
    """
    found = stored(noticed(files, carried), "notices")
    some = found.where(F.size("parts") > 0).withColumn("file", F.xxhash64("path", F.col("path").isNull(), "parts"))
    held = stored(some.select("file", "parts").dropDuplicates(["file"]).select("file", F.explode("parts").alias("p")).select("file", F.md5(F.col("p.terms").cast("binary")).alias("id"), "p.terms", "p.window"), "passages")
    close = stored(similarities(held.select("id", "terms").dropDuplicates(["id"])), "similarities")
    matched = held.select("file", "id", "window").join(F.broadcast(close) if close.count() <= FEW else close, "id").where(~F.col("window") | (F.col("cosine") >= WINDOW_COSINE))
    best = matched.groupBy("file").agg(F.max(F.struct("cosine", "license")).alias("b"))
    # files without passages, most of them, need no join (null keys would meet in one task)
    own = some.select("path", "row", "file").join(best, "file", "left").select("path", "row", "b").unionByName(found.where(F.size("parts") <= 0).select("path", "row"), allowMissingColumns=True)
    own = stored(own.select("path", "row", _above(F.col("path")).alias("dir"), F.col("b.license").alias("own_license"), F.coalesce("b.cosine", F.lit(0.0)).alias("similarity")), "own-licenses")
    gives = own.where(F.col("own_license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    sources = stored(gives.groupBy("dir").agg(F.min(F.struct("path", F.col("own_license").alias("license"))).alias("from")), "licence-files")
    lacking = own.where("own_license IS NULL AND dir IS NOT NULL")
    near = stored(nearest(lacking.select("dir").distinct(), sources), "inherited").select(F.col("dir").alias("i_dir"), "from")
    # only files that lack a licence are joined, so a directory of very many files is dealt over salts
    told = own.withColumn("part", F.when(F.col("own_license").isNull(), F.pmod(F.xxhash64("path", "row"), F.lit(SALTS)).cast("int")))
    if near.count() <= FEW:
        out = told.join(F.broadcast(near), F.col("own_license").isNull() & (F.col("dir") == F.col("i_dir")), "left")
    else:
        spread = near.withColumn("i_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = told.where("part IS NOT NULL").join(spread, (F.col("dir") == F.col("i_dir")) & (F.col("part") == F.col("i_part")), "left").unionByName(told.where("part IS NULL"), allowMissingColumns=True)
    return out.select("path", "own_license", "similarity", F.coalesce("own_license", "from.license").alias("license"), F.col("from.path").alias("inherited_from"), *[F.col(f"row.`{c}`") for c in carried])
