"""License scan: MinHash of overlapping windows retrieves templates, shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table

#: Words a shingle; shingles a window and from one window to the next; permutations, each a band of one row.
WORDS, WINDOW, STRIDE, BANDS = 5, 16, 8, 12
#: Share of a template's shingles that a document must contain, and of those that no similar template has.
CONTAINMENT, OWN = 0.8, 0.5
#: Share of a template's shingles in another one from which on the two are similar.
SIMILAR = 0.4

# Notices and key passages of public licences, as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Affero General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Lesser General Public License for more details."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def normal_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, as the scan splits texts."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingle_texts(text: str) -> list[str]:
    words = normal_words(text)
    return [" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def own_shingles(templates: dict[str, str]) -> dict[str, list[list[str]]]:
    """Per template and similar template the shingles that the one has and the other has not: they tell versions of one text apart.

    A template that another one contains whole is no version of it: a document with the longer one has both.
    """
    sets = {name: set(shingle_texts(t)) for name, t in templates.items()}
    near = lambda mine, other: mine & other and mine - other and len(mine & other) >= SIMILAR * len(mine)
    return {name: [sorted(mine - other) for rival, other in sorted(sets.items()) if rival != name and near(mine, other)] for name, mine in sets.items()}


def _seeds(bands: int) -> list[int]:
    draw = random.Random(42)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(bands)]


def _literal(values, kind: str):
    """A constant array column."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, licenses (array of struct name, containment; sorted by name), n_licenses.

    Texts are split into lower-cased words and these into shingles of five. Windows of 16 shingles, 8 apart (the last
    may be shorter), get 12 MinHashes, each a band of its own, so a window of similarity s to a window of a template
    meets it with a chance of 1 - (1 - s)^12: over 0.9997 at s = 0.5. Every run of 24 shingles copied from a
    template holds a whole window, of similarity 1 as the templates have windows at every offset. Templates under 24
    shingles are met through windows of one shingle, whose MinHash is the shingle's hash: whatever contains a share of
    such a template meets it for certain. What is met is verified by exact containment: the share of the template's
    distinct shingles that occur in the document, compared as texts. Where other templates are much the same, as other
    versions' notices are, OWN of the shingles that this one has beyond each of them must occur too.

    All is done row by row from constants of the fixed size of the templates, so nothing is shuffled. Null, empty
    and short texts contain nothing. Repeated rows get rows of their own; an empty table gives none; other columns of
    `docs` are not read. The templates are few and constant; a template of under five words is an error.
    """
    templates = TEMPLATES if templates is None else templates
    parts = {name: sorted(set(shingle_texts(t))) for name, t in templates.items()}
    if short := [name for name, p in parts.items() if not p]:
        raise ValueError(f"templates of under {WORDS} words: {short}")
    own = own_shingles(templates)
    rows = [(name, i, s) for name, t in templates.items() for i, s in enumerate(shingle_texts(t))]
    # The templates' hashes come from the same engine as the documents': one small job over constants.
    hashed = {(r["name"], r["i"]): r["h"] for r in spark.createDataFrame(rows, "name string, i int, s string").select("name", "i", F.xxhash64("s").alias("h")).collect()}
    seeds, keys = _seeds(BANDS), {}
    for name, t in templates.items():
        h = [hashed[name, i] for i in range(len(shingle_texts(t)))]
        found = set(h) if len(h) < WINDOW + STRIDE else set()
        if len(h) >= WINDOW + STRIDE:
            found = {min(x ^ s for x in h[i : i + WINDOW]) ^ s for i in range(len(h) - WINDOW + 1) for s in seeds}
        keys[name] = sorted(found)
    table = [{"name": name, "keys": keys[name], "shingles": parts[name], "own": own[name]} for name in sorted(templates)]
    library = F.from_json(F.lit(json.dumps(table)), "array<struct<name: string, keys: array<bigint>, shingles: array<string>, own: array<array<string>>>>")
    short = _literal(sorted({k for n in keys for k in keys[n] if len(shingle_texts(templates[n])) < WINDOW + STRIDE}), "bigint")
    long = _literal(sorted({k for n in keys for k in keys[n] if len(shingle_texts(templates[n])) >= WINDOW + STRIDE}), "bigint")

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    # A shingle's text, and so its hash, is that of its words joined by spaces.
    texts = F.when(F.size("words") >= WORDS, F.transform(F.slice("words", 1, F.greatest(F.size("words") - (WORDS - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(F.get("words", i + k) for k in range(1, WORDS))))).otherwise(F.array().cast("array<string>"))
    base = base.select("doc_id", texts.alias("shingles"))
    base = base.select("doc_id", "shingles", F.transform("shingles", lambda s: F.xxhash64(s)).alias("h"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(STRIDE))
    # min(x ^ seed) ^ seed is the shingle hash that a permutation of the hash space puts first.
    def first(p, seed):
        return F.array_min(F.transform(F.slice("h", p + 1, WINDOW), lambda x: x.bitwiseXOR(F.lit(seed)))).bitwiseXOR(F.lit(seed))

    mins = F.flatten(F.transform(starts, lambda p: F.array(*(first(p, seed) for seed in seeds))))
    base = base.select("doc_id", "shingles", F.concat(F.array_intersect("h", short), F.array_intersect(mins, long)).alias("met"))
    # A generator is where a filter on the result ends: pushed further down, it would repeat the whole search in each of its terms.
    base = base.select("doc_id", F.inline(F.array(F.struct("shingles", "met"))))
    share = lambda part: F.size(F.array_intersect(part, F.col("shingles"))) / F.size(part)
    met = F.filter(library, lambda t: F.arrays_overlap(t.getField("keys"), F.col("met")))
    found = F.transform(met, lambda t: F.struct(t.getField("name").alias("name"), share(t.getField("shingles")).alias("containment"), t.getField("own").alias("own")))
    verified = F.filter(found, lambda v: (v.containment >= containment) & F.forall(v.own, lambda part: share(part) >= OWN))
    verified = F.transform(verified, lambda v: F.struct(v.getField("name").alias("name"), v.containment.alias("containment")))
    empty = F.array().cast("array<struct<name: string, containment: double>>")
    return base.select("doc_id", F.when(F.size("met") > 0, verified).otherwise(empty).alias("licenses")).withColumn("n_licenses", F.size("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.transform("licenses", lambda v: F.concat(v["name"], F.lit("="), F.format_string("%.4f", v["containment"]))).alias("found"), "n_licenses").select("doc_id", F.array_join("found", ";").alias("licenses"), "n_licenses")


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL of `query`: the containment of every template in every document, without retrieval."""
    quoted = lambda parts: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in parts) + "]"
    own = own_shingles(templates)
    rows = ", ".join(f"('{n}', {quoted(sorted(set(shingle_texts(t))))}, CAST([{', '.join(map(quoted, own[n]))}] AS VARCHAR[][]))" for n, t in sorted(templates.items()))
    return f"""
WITH t(name, parts, own) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - {WORDS - 2}, 1)), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))) AS parts FROM w),
c AS (SELECT doc_id, name, len(list_intersect(t.parts, s.parts)) / len(t.parts) AS share, len(list_filter(t.own, lambda o: len(list_intersect(o, s.parts)) < {OWN} * len(o))) = 0 AS own FROM s, t),
found AS (SELECT doc_id, string_agg(name || '=' || printf('%.4f', share), ';' ORDER BY name) AS licenses, count(*) AS n FROM c WHERE share >= {CONTAINMENT} AND own GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS INTEGER) AS n_licenses FROM documents LEFT JOIN found USING (doc_id)
"""
