"""License scan: templates are retrieved with MinHash bands over overlapping windows.

1. Words are lower-case runs of letters and digits; a shingle is ``SHINGLE`` words. A shorter
   template is one shingle of all its words, and texts are hashed at that width too.
2. Windows of ``2 x STRIDE`` words, ``STRIDE`` apart, cover every text, so any ``STRIDE``
   words in a row lie in one window. Templates are cut into pieces of at most ``STRIDE``
   words. A window's set holds its shingles that any template has: a shingle that no
   template has can't be a common min-hash, so leaving it out loses nothing, and windows
   without any are never built. Each width of shingles has windows of its own.
3. ``BANDS`` bands of one min-hash retrieve pieces. A window's set has 60 shingles at most, so
   even a template of a single shingle, beside 59 of others, has J = 1/60 and meets in some
   band with 1 - (1 - 1/60)^512 > 0.9998; longer templates meet all but surely. A template of
   w < ``SHINGLE`` words stands beside 64 - w others of its width at most (1/64: > 0.9996).
4. Retrieved templates are verified by exact containment: of a template's different
   shingles, ``CONTAINMENT`` at least stand in the document's retrieved windows. Of two matched
   templates of which one mostly stands in the other, the longer one is reported.

All of it is DataFrame functions. A group is one window or one (document, template), so
popular licenses make no large group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import id_key

SHINGLE, STRIDE, BANDS, CONTAINMENT = 5, 32, 512, 0.8
#: Templates with more shingles and bands in all are joined without a broadcast hint.
BROADCAST_ROWS = 200_000

# Notices, grant paragraphs and short texts of public licenses.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain."
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

# Shorter than a shingle. The line grants nothing, but it stands where a license would.
SHORT_NOTICES = {"All rights reserved (notice)": "All rights reserved."}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def width(words: list[str]) -> int:
    """Words in a shingle of a template."""
    return min(SHINGLE, len(words))


def template_pieces(templates: dict[str, str]) -> list[tuple[str, int, list[str]]]:
    """(template, piece, shingles) of pieces of at most STRIDE words that overlap by SHINGLE - 1.

    A template of fewer words than SHINGLE is one piece of one shingle.
    """
    out = []
    for name, text in templates.items():
        w = template_words(text)
        if not w:
            raise ValueError(f"template {name}: no words")
        shingles = [" ".join(w[i : i + width(w)]) for i in range(len(w) - width(w) + 1)]
        step = STRIDE - SHINGLE + 1
        out += [(name, k, shingles[a : a + step]) for k, a in enumerate(range(0, len(shingles), step))]
    return out


def bands(known: Column) -> Column:
    """Hashes of the bands of a set of shingle hashes: the least hash under each of BANDS hash functions."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda b: F.xxhash64(b, F.array_min(F.transform(known, lambda x: F.xxhash64(x, b)))),
    )


def superseded(templates: dict[str, str]) -> list[tuple[str, str]]:
    """(license, other): templates that mostly stand in a longer one. A match of the longer one is the specific one."""
    sets = {}
    for name, text in templates.items():
        w = template_words(text)
        sets[name] = {tuple(w[i : i + width(w)]) for i in range(len(w) - width(w) + 1)}
    return [
        (a, b)
        for a, x in sets.items()
        for b, y in sets.items()
        if len(x) < len(y) and len(x & y) >= CONTAINMENT * len(x)
    ]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word and n_windows of every match.

    ``first_word`` is the place of the first matched shingle. Null and empty texts match
    nothing; a null doc_id stays null. Equal rows are one document and match once; rows
    with one id and different texts are scanned each. Other columns are left out, and an
    empty table gives no rows. Word order inside shingles counts, case and punctuation don't.
    Without ``templates``, TEMPLATES and SHORT_NOTICES are looked for.
    """
    spark = docs.sparkSession
    templates = TEMPLATES | SHORT_NOTICES if templates is None else templates
    made = template_pieces(templates)
    widths = sorted({width(template_words(t)) for t in templates.values()})
    table = spark.createDataFrame(made, "license string, piece int, shingles array<string>")
    hashed = table.select("license", "piece", F.transform("shingles", lambda s: F.xxhash64(s)).alias("shingles"))
    # Broadcast only up to a size that is checked: a row of at most 60 bytes a shingle or band.
    total = sum(len(x) for _, _, x in made) + BANDS * len(made)
    small = F.broadcast if total <= BROADCAST_ROWS else (lambda t: t)
    wanted = small(hashed.select(F.explode("shingles").alias("s")).distinct())
    index = small(
        hashed.select("license", "piece", F.explode(bands(F.array_distinct("shingles"))).alias("band")).distinct()
    )
    wholes = small(
        hashed.groupBy("license").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("whole"))
    )

    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    texts = docs.where(F.col("text").isNotNull()).select(
        id_key().alias("doc_id"), F.xxhash64("text").alias("text_hash"), words.alias("w")
    )
    texts = texts.where(F.size("w") >= widths[0])

    def shingles(n: int) -> Column:
        found = F.transform(
            F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))
        )
        return found if n == widths[0] else F.when(F.size("w") >= n, found)

    by_width = F.explode(F.array(*(F.struct(F.lit(n).alias("width"), shingles(n).alias("found")) for n in widths))).alias("x")
    hits = (
        texts.select("doc_id", "text_hash", by_width)
        .select("doc_id", "text_hash", F.col("x.width").alias("width"), F.posexplode("x.found").alias("at", "s"))
        .join(wanted, "s")
    )
    # Window j holds the words from STRIDE x j on; a shingle fits into one or two.
    j = F.floor(F.col("at") / STRIDE).cast("int")
    fits = F.filter(F.array(j - 1, j), lambda x: (x >= 0) & (F.col("at") + F.col("width") <= (x + 2) * STRIDE))
    windows = (
        hits.select("doc_id", "text_hash", "width", F.explode(fits).alias("window"), "s", "at")
        .groupBy("doc_id", "text_hash", "width", "window")
        .agg(F.collect_set("s").alias("known"), F.min("at").alias("at"), F.collect_list(F.struct("at", "s")).alias("places"))
    )
    met = (
        windows.select("*", F.explode(bands(F.col("known"))).alias("band"))
        .join(index, "band")
        .select("doc_id", "text_hash", "width", "window", "known", "places", "license")
        .distinct()
    )
    verified = (
        met.groupBy("doc_id", "text_hash", "license")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("known"))).alias("found"),
            F.flatten(F.collect_list("places")).alias("places"),
            F.count(F.lit(1)).alias("n_windows"),
        )
        .join(wholes, "license")
        .withColumn("containment", F.size(F.array_intersect("found", "whole")) / F.size("whole"))
        .where(F.col("containment") >= CONTAINMENT)
    )
    first = F.array_min(F.transform(F.filter("places", lambda p: F.array_contains(F.col("whole"), p["s"])), lambda p: p["at"]))
    found = verified.select(
        "doc_id",
        "text_hash",
        "license",
        F.round("containment", 6).alias("containment"),
        first.cast("long").alias("first_word"),
        F.col("n_windows").cast("long").alias("n_windows"),
    )
    matches = found.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("license", "containment", "first_word", "n_windows")).alias("matches")
    )
    pairs = [f"{a}\n{b}" for a, b in superseded(templates)]
    if pairs:
        longer = lambda x: F.exists("matches", lambda y: F.concat_ws("\n", x["license"], y["license"]).isin(pairs))
        matches = matches.withColumn("matches", F.filter("matches", lambda x: ~longer(x)))
    return matches.select("doc_id", F.explode("matches").alias("x")).select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "x.*"
    )
