"""Licence scan by Dice coefficient over word bigrams, with DataFrame functions only.

Units of a text are its lines, its paragraphs (cut at blank lines) and the
whole text.  A unit of b distinct bigrams can only reach the coefficient t with a
template of n bigrams if ``n*t/(2-t) <= b <= n*(2-t)/t``; units and templates
outside these bounds never meet, and a unit without any of the templates' key words
is left at once.  The others meet on their bigrams, against a table of fixed size.

A notice that is part of a longer line, or wrapped over lines of a longer paragraph,
is found in runs of words of the whole text, from one bigram of a template to another.
Of runs that overlap the best one counts.  Runs speak for licences of which no line,
paragraph or whole text has a notice; they also meet the texts of licences.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices (fixed values): (licence, notice).
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction,'
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Licences that a tag in a source file can name (fixed values), beside those that have a notice.
TAGGED = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
#: A tag that names none of these; without it, the tag's own words would be most of the nearest template.
OTHER_TAG = "SPDX-other"
_TAG = "SPDX-License-Identifier"
TEMPLATES += [(name, f"{_TAG}: {name}") for name in TAGGED] + [(OTHER_TAG, _TAG)]

_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License"
    " as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
#: Texts of licences (fixed values), for runs of words only.
TEXTS = [
    ("AGPL-3.0", _GNU.format("program", ":", "Affero", "3")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND"
        " DISTRIBUTION",
    ),
    ("BSD-2-Clause", _BSD),
    (
        "BSD-3-Clause",
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
    (
        "CC0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her"
        " rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by"
        " law.",
    ),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", _GNU.format("program", ";", "", "2")),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("program", ":", "", "3")),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser", "2.1")),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", _GNU.format("program", ":", "Lesser", "3")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]

THRESHOLD = 0.8


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams that can reach the threshold with n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def key_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which a unit has at least one if it reaches the threshold with any template.

    Such a unit shares at least ``n*t/(2-t)`` of a template's n bigrams, so it is enough
    to take words, long ones first, until fewer bigrams than that are without one.
    """
    keys: set[str] = set()
    for _, notice in templates:
        left = [g.split() for g in bigrams_of(notice)]
        need = max(1, bounds(len(left), threshold)[0])
        for word in sorted({w for g in left for w in g}, key=lambda w: (-len(w), w)):
            if len(left) < need:
                break
            keys.add(word)
            left = [g for g in left if word not in g]
    return sorted(keys)


def _has_key(text: Column, keys: list[str]) -> Column:
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [F.contains(low, F.lit(k)) for k in keys]))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def runs(rows: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """Runs of words that reach the threshold with a template, the best of each place: id, unit, license, dice, run.

    Rows have id and text.  A run begins and ends with a bigram of the template.  Its
    template bigrams count once, each other bigram as often as it stands there.
    """
    known, spans = [], []
    for i, (_, notice) in enumerate(templates):
        grams = bigrams_of(notice)
        length = len(re.findall("[a-z0-9]+", notice.lower())) - 1
        spans.append((len(grams), bounds(len(grams), threshold)[0], bounds(length, threshold)[1]))
        known += [(g, i, k) for k, g in enumerate(grams)]
    table = rows.sparkSession.createDataFrame(known, "t_gram string, template int, g int")
    # a bigram meets all templates that have it at once
    table = table.groupBy("t_gram").agg(F.collect_list(F.struct("template", "g")).alias("of"))
    text, words = F.col("text"), F.col("words")
    keys = key_words(templates, threshold)
    per = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in spans]), F.col("template") + 1)
    pairs = F.zip_with(
        F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    hits = (
        rows.where(text.isNotNull() & _has_key(text, keys))
        .select("id", F.xxhash64("text").alias("copy"), _words(text).alias("words"))
        .where(F.size(words) > 1)
        .select("id", "copy", F.posexplode(pairs).alias("pos", "gram"))
        .join(F.broadcast(table), F.col("gram") == F.col("t_gram"))
        .select("id", "copy", "pos", F.explode("of").alias("of"))
        .groupBy("id", "copy", "of.template")
        .agg(F.sort_array(F.collect_set(F.struct("pos", F.col("of.g").alias("g")))).alias("hits"))
        .withColumns({"size": per(0), "low": per(1), "span": per(2)})
        .where(F.size("hits") >= F.col("low"))
    )
    pos = lambda i: F.get("hits", i)["pos"]
    # places from which enough bigrams of the template stand close together
    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - F.col("low")), lambda i: pos(i + F.col("low") - 1) - pos(i) < F.col("span"))

    def best_from(i: Column) -> Column:
        within = F.filter(F.slice("hits", i + 1, F.col("span")), lambda h: h["pos"] - pos(i) < F.col("span"))
        nothing = F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("shared"), F.lit(0).alias("end"))

        def add(acc: Column, h: Column) -> Column:
            seen = F.array_union(acc["seen"], F.array(h["g"]))
            n = acc["n"] + 1
            # the run's length less its repeated template bigrams
            dice = 2.0 * F.size(seen) / (h["pos"] - pos(i) + 1 - (n - F.size(seen)) + F.col("size"))
            here = F.struct(dice.alias("dice"), F.size(seen).alias("shared"), h["pos"].alias("end"))
            return F.struct(n.alias("n"), seen.alias("seen"), F.greatest(acc["best"], here).alias("best"))

        first = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("seen"), nothing.alias("best"))
        return F.aggregate(within, first, add, lambda acc: acc["best"])

    ranked = F.transform(
        starts,
        lambda i: F.transform(
            F.array(best_from(i)),
            lambda b: F.struct(
                (-b["dice"]).alias("less"), (-b["shared"]).alias("fewer"), F.col("template"), pos(i).alias("start"), b["end"].alias("end"),
                F.xxhash64(F.transform(F.filter("hits", lambda h: h["pos"].between(pos(i), b["end"])), lambda h: h["g"])).alias("unit"),
            ),
        )[0],
    )
    each = hits.select("id", "copy", F.explode(F.filter(ranked, lambda r: -r["less"] >= threshold)).alias("r"))
    # a run of words a to b has the bigrams a to b - 1, so runs without a common word are two bigrams apart
    apart = lambda kept, r: F.forall(kept, lambda k: (k["end"] + 1 < r["start"]) | (r["end"] + 1 < k["start"]))
    chosen = each.groupBy("id", "copy").agg(F.sort_array(F.collect_set("r")).alias("all")).select(
        "id",
        F.explode(
            F.aggregate("all", F.slice("all", 1, 0), lambda kept, r: F.when(apart(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
        ).alias("r"),
    )
    names = F.array(*[F.lit(name) for name, _ in templates])
    return chosen.select(
        "id", F.xxhash64("r.template", "r.unit").alias("unit"), F.element_at(names, F.col("r.template") + 1).alias("license"),
        (-F.col("r.less")).alias("dice"), F.lit(True).alias("run"),
    )


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: list[tuple[str, str]] = TEXTS,
) -> DataFrame:
    """One row per document and licence found: id, license, dice, units.

    ``dice`` is the best coefficient of a unit with a notice of that licence, and
    ``units`` the number of different units for which a notice of that licence is
    the best one (of equal ones the first template).  Null and empty texts have no
    licence.  A licence without such a unit is found by runs of words, which also meet
    ``texts``; then these are its units.  A tag (``SPDX-License-Identifier``) is a notice of the licence that it
    names, ``SPDX-other`` if that has no template; of several licences in one tag only one counts.
    Rows that share an id, null included, are one document with the units of all of its
    texts, and rows that repeat id and text count once.  Texts may be of
    any length; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = []
    for i, (name, notice) in enumerate(templates):
        grams = bigrams_of(notice)
        low, high = bounds(len(grams), threshold)
        rows += [(i, name, len(grams), low, high, g) for g in grams]
    known = spark.createDataFrame(rows, "template int, license string, t_size int, low int, high int, t_gram string")
    least, most = min(r[3] for r in rows), max(r[4] for r in rows)

    text, keys = F.col("text"), key_words(templates, threshold)
    pieces = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))
    # distinct bigrams are at most words - 1; words are at most (length + 1) / 2
    likely = F.filter(pieces, lambda u: (F.length(u) >= 2 * least + 1) & _has_key(u, keys))
    units = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .where(text.isNotNull() & _has_key(text, keys))
        .select("id", F.explode(F.transform(likely, _words)).alias("words"))
    )
    # every distinct word but the first ends a bigram of its own
    distinct = F.size(F.array_distinct("words"))
    units = units.where((F.size("words") > least) & (distinct - 1 <= most)).select(
        "id",
        F.array_distinct(
            F.zip_with(
                F.slice("words", 1, F.size("words") - 1),
                F.slice("words", 2, F.size("words") - 1),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        ).alias("grams"),
    )
    units = units.withColumn("n", F.size("grams")).where(F.col("n").between(least, most))
    met = (
        units.select("id", "n", F.xxhash64("grams").alias("unit"), F.explode("grams").alias("gram"))
        .join(
            F.broadcast(known), (F.col("gram") == F.col("t_gram")) & F.col("n").between(F.col("low"), F.col("high"))
        )
        .groupBy("id", "unit", "n", "template", "license", "t_size")
        .agg(F.size(F.collect_set("gram")).alias("shared"))
        .withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("t_size")))
        .where(F.col("dice") >= threshold)
    )
    best = met.groupBy("id", "unit").agg(
        F.max(F.struct(F.col("dice"), -F.col("template"), F.col("license"))).alias("best")
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = best.select("id", "unit", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), F.lit(False).alias("run"))
    found = found.unionByName(runs(rows, [*templates, *texts], threshold))
    own = ~F.col("run")
    return found.groupBy(F.col("id").alias(id_col), "license").agg(
        F.coalesce(F.max(F.when(own, F.col("dice"))), F.max("dice")).alias("dice"),
        F.when(F.max(own), F.count(F.when(own, 1))).otherwise(F.count_distinct("unit")).alias("units"),
    )


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same as DuckDB SQL, over ``documents``."""
    known = []
    for i, (name, notice) in enumerate(templates):
        grams = bigrams_of(notice)
        known.append(f"({i}, '{name}', [{', '.join(repr(g) for g in grams)}])")
    return rf"""
with known(template, license, grams) as (values {', '.join(known)}),
units as (
  select distinct doc_id,
         list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as grams
  from (
    select doc_id, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') as words
    from (
      select doc_id, unnest(list_concat(string_split(text, chr(10)),
                                        regexp_split_to_array(text, '\n[ \t\r]*\n'), [text])) as unit
      from documents where text is not null
    )
  )
),
met as (
  select doc_id, u.grams, template, license,
         2.0 * len(list_intersect(u.grams, k.grams)) / (len(u.grams) + len(k.grams)) as dice
  from units u join known k on len(u.grams) > 0 and list_has_any(u.grams, k.grams)
),
best as (
  select doc_id, grams, license, dice,
         row_number() over (partition by doc_id, grams order by dice desc, template) as place
  from met where dice >= {threshold}
)
select doc_id, license, max(dice)::double as dice, count(*) as units
from best where place = 1 group by doc_id, license
"""
