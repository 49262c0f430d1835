"""License scans, with DataFrame operations only.

Every line of a text and every paragraph of several lines (up to an empty one) is normalised to lower-case
words and compared with licence templates by the Dice coefficient of their sets of word
bigrams. Two sets of sizes a and b reach at most 2 * min(a, b) / (a + b): a template whose size
is out of these bounds for the segment is not compared at all.

Notices also stand inside longer lines, over several lines or as full texts: the windows of a
template's length over the words of the whole text are compared with every template, with the
notices of MORE and the full texts of license_texts. A window begins at any word; the distinct
bigrams of all windows, and those shared with the template, are running sums over the places
where a bigram comes in or drops out. Of windows that overlap, the one with most shared bigrams
counts (then higher Dice, then name, then place). It is one more segment unless a line it
touches matches as well or better, or a paragraph has given its name; it replaces lines it
touches that match worse. A template is looked for only in texts that hold two thirds of its
bigrams: a Dice of 0.8 is out of reach in all others. So a few words are enough to tell texts
that no template can match: words that together touch more than a third of the bigrams of
every template. A text without any of them is not taken apart at all.

Null and empty texts have no segments. Of the templates that a segment matches, the best counts
(on ties the first name). Repeated rows are scanned one by one. Other columns are ignored.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices that announce a licence, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_HEADER = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices for windows only.
MORE = (
    *((x, f"SPDX-License-Identifier: {x}") for x in ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense")),
    *((x, f"SPDX-License-Identifier: {x}{e}") for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for e in ("", "-only", "-or-later")),
    *((x, f"licensed under the {n}") for x, n in (("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("Unlicense", "Unlicense"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"), ("AGPL-3.0", "AGPLv3"), ("LGPL-3.0", "LGPLv3"))),
    *((x, f"GNU {n} License {v}") for x, n, k in (("AGPL-3.0", "Affero General Public", "3"), ("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-3.0", "Lesser General Public", "3")) for v in (f"version {k}", f"v{k}", f"v{k}.0")),
    ("MIT", "The MIT License (MIT)"),
    ("CC-BY-4.0", "licensed under CC-BY-4.0"),
    ("CC-BY-NC-4.0", "licensed under CC-BY-NC-4.0"),
    ("CC-BY-SA-4.0", "licensed under CC-BY-SA-4.0"),
    ("GPL-2.0", "This program " + _HEADER.format("General Public License", "2")),
    ("AGPL-3.0", "This program " + _HEADER.format("Affero General Public License", "3")),
    ("LGPL-2.1", "This library " + _HEADER.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This library " + _HEADER.format("Lesser General Public License", "3")),
)
_FULL = Path(__file__).with_name("license_texts")
MIN_DICE = 0.8


def normal_words(text) -> F.Column:
    """Lower-cased words of letters and digits (non-ASCII characters count as letters)."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z\u0080-\x{10FFFF}]+", " ")), " ")


def bigrams(words) -> F.Column:
    n = F.size(words)
    return F.array_distinct(F.transform(F.slice(words, 1, n - 1), lambda w, i: F.concat_ws(" ", w, F.element_at(words, i + 2))))


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in text.lower()).split()


def _plain(text: str) -> list[str]:
    kept = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(kept, kept[1:])})


def _templates() -> list[tuple[str, list[str]]]:
    return [(name, _plain(text)) for name, text in TEMPLATES]


def _for_windows() -> list[tuple[str, list[str], int]]:
    """Name, bigrams and number of bigram places of all templates."""
    full = [(p.stem, p.read_text()) for p in sorted(_FULL.glob("*.txt"))]
    return [(name, _plain(text), len(_words(text)) - 1) for name, text in (*TEMPLATES, *MORE, *full)]


#: Frequent words, which tell little. They are taken for guards last.
_FREQUENT = frozenset("the of and to a in is for with on that this by it from as be are an or at was not you your any all which may use".split())


def guards(templates: list[tuple], least: float) -> list[str]:
    """Words, one of which at least is in every text that holds `least` of a template's bigrams, whichever template it is: a greedy cover."""
    touched: dict[str, dict[int, set]] = {}
    for i, (_, grams, *_rest) in enumerate(templates):
        for g in grams:
            for w in g.split(" "):
                touched.setdefault(w, {}).setdefault(i, set()).add(g)
    need = [math.floor(len(grams) * (1 - least) + 1e-6) + 1 for _, grams, *_rest in templates]
    left, chosen = [set(grams) for _, grams, *_rest in templates], []
    while any(n > 0 for n in need):
        gain = lambda w: sum(min(need[i], len(gs & left[i])) / len(templates[i][1]) for i, gs in touched[w].items() if need[i] > 0)
        best = min(touched, key=lambda w: (-gain(w) * (0.02 if w in _FREQUENT else 1.0), w))
        chosen.append(best)
        for i, gs in touched.pop(best).items():
            need[i] -= len(gs & left[i])
            left[i] -= gs
    return chosen


def _possible(text, templates: list[tuple], least: float) -> F.Column:
    """Whether the text has one of the guards as a word. The pattern tries words by their first letters, after an ASCII character that is no part of a word."""
    starts: dict[str, list[str]] = {}
    for w in sorted(guards(templates, least)):
        starts.setdefault(w[0], []).append(w[1:])
    words = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in starts.items())
    edge = r"[\x00-/:-`{-\x7F]"
    return F.rlike(F.lower(text), F.lit(rf"(?:^|{edge})(?:{words})(?:\z|{edge})"))


def _windows(text, min_dice: float) -> F.Column:
    """Array of the windows that count: shared, minus (the Dice, negated), name, at, to (places of bigrams), line, last."""
    known = _for_windows()
    whole = F.coalesce(text, F.lit(""))
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  # evaluates value once
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(length).alias("length"), F.split(F.lit("|".join(g)), r"\|").alias("grams")) for name, g, length in known))
    least = min_dice / (2 - min_dice) - 1e-9  # 2 c / (m + n) >= d with m >= c needs c >= n * d / (2 - d)
    every = lambda few: F.split(F.lit("|".join(sorted({g for _, grams, _ in few for g in grams}))), r"\|")
    long = 2 * least * 200  # shortest text that any template of more than 200 bigrams can match
    looked_for = F.when(F.length(whole) < long, every([t for t in known if len(t[1]) <= 200])).otherwise(every(known))
    words = F.flatten(F.transform(F.split(whole, "\n"), lambda x, i: F.transform(F.filter(normal_words(x), lambda w: w != ""), lambda w: F.struct(w.alias("word"), (i + 1).alias("line")))))

    def of_template(words, occurrences, t):
        def changes(o):
            hit = F.array_contains(t["grams"], o["gram"]).cast("int")
            first = F.greatest(o["before"] + 1, o["at"] - t["length"] + 1, F.lit(0))
            return F.array(F.struct(first.alias("at"), hit.alias("c"), F.lit(1).alias("m")), F.struct((o["at"] + 1).alias("at"), (-hit).alias("c"), F.lit(-1).alias("m")))

        point = "struct<shared:int,minus:double,at:int>"
        nothing = F.lit(None).cast(point)
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("c"), F.lit(0).alias("m"), nothing.alias("best"), F.array().cast(f"array<{point}>").alias("done"))

        def step(s, e):
            moved = e["at"] > s["at"]
            minus = -2.0 * s["c"] / (s["m"] + t["n"])
            here = F.struct(s["c"].alias("shared"), minus.alias("minus"), s["at"].alias("at"))
            fits = moved & (minus <= -min_dice)
            better = s["best"].isNull() | (s["c"] > s["best"]["shared"]) | (s["c"] == s["best"]["shared"]) & (minus < s["best"]["minus"])
            ends = moved & ~fits & s["best"].isNotNull()
            best = F.when(fits & better, here.cast(point)).when(ends, nothing).otherwise(s["best"])
            done = F.when(ends, F.concat(s["done"], F.array(s["best"]))).otherwise(s["done"])
            return F.struct(e["at"].alias("at"), (s["c"] + e["c"]).alias("c"), (s["m"] + e["m"]).alias("m"), best.alias("best"), done.alias("done"))

        events = F.sort_array(F.flatten(F.transform(occurrences, changes)))
        events = F.concat(events, F.array(*(F.struct((F.size(occurrences) + k).alias("at"), F.lit(0).alias("c"), F.lit(0).alias("m")) for k in (1, 2))))
        found = F.aggregate(events, start, step, lambda s: s["done"])
        return F.transform(found, lambda p: let(F.least(p["at"] + t["length"], F.size(occurrences)), lambda to: F.struct((-p["shared"]).alias("fewer"), p["minus"].alias("minus"), t["name"].alias("name"), p["at"].alias("at"), to.alias("to"), words[p["at"]]["line"].alias("line"), words[to]["line"].alias("last"))))

    def of_words(words):
        pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w["word"], words[i + 1]["word"]).alias("gram"), i.alias("at")))

        def of_pairs(pairs):
            ordered = F.sort_array(pairs)
            seen = lambda o: F.transform(o, lambda p, i: F.struct(p["gram"].alias("gram"), p["at"].alias("at"), F.when((i > 0) & (F.get(o, i - 1)["gram"] == p["gram"]), F.get(o, i - 1)["at"]).otherwise(F.lit(-1)).alias("before")))
            shared = F.array_intersect(looked_for, F.transform(pairs, lambda p: p["gram"]))
            fitting = let(shared, lambda g: F.filter(table, lambda t: (F.size(g) >= t["n"] * F.lit(least)) & (F.size(F.array_intersect(g, t["grams"])) >= t["n"] * F.lit(least))))
            return let(fitting, lambda few: F.when(F.size(few) > 0, let(let(ordered, seen), lambda o: F.flatten(F.transform(few, lambda t: of_template(words, o, t))))))

        return let(pairs, of_pairs)

    kind = "array<struct<fewer:int,minus:double,name:string,at:int,to:int,line:int,last:int>>"
    none = F.array().cast(kind)
    overlap = lambda a, b: (a["at"] < b["to"]) & (b["at"] < a["to"])
    chosen = F.aggregate(F.sort_array(F.coalesce(let(words, of_words).cast(kind), none)), none, lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return chosen


def scan(docs: DataFrame, min_dice: float = MIN_DICE, doc_id: str = "doc_id", text: str = "text", guarded: bool = True) -> DataFrame:
    """doc_id, n_lines, n_segments that match, licenses (names, sorted, comma-joined), best_license, best_dice and best_line (from 1; 0: a paragraph; of a window, where it begins)."""
    known = _templates()
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    least = min(len(g) for _, g in known) * low
    all_lines = F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    some = F.when(_possible(F.col(text), _for_windows(), low - 1e-9), F.col(text)) if guarded else F.col(text)
    given = docs.select(F.col(doc_id).alias("doc_id"), all_lines.cast("long").alias("n_lines"), some.alias("text"))  # null: nothing can match
    whole = F.col("text")
    paragraphs = F.filter(F.split(whole, r"\n[\x09-\x0D\x20]*\n"), lambda x: F.contains(x, F.lit("\n")))
    few = given.select("doc_id", "n_lines", F.split(whole, "\n").alias("lines"), paragraphs.alias("paragraphs"), F.when(whole.isNotNull(), _windows(whole, min_dice)).alias("windows"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("segment")))
    lines = F.concat(numbered, F.transform("paragraphs", lambda x: F.struct(F.lit(0).alias("line"), x.alias("segment"))))
    grams = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), normal_words(x["segment"]).alias("words")))
    grams = F.filter(grams, lambda x: F.size(x["words"]) - 1 >= F.lit(least))
    grams = F.transform(grams, lambda x: F.struct(x["line"].alias("line"), bigrams(x["words"]).alias("grams")))
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known))

    def compare(s):
        size = F.size(s["grams"])
        fitting = F.filter(table, lambda t: (size >= t["n"] * F.lit(low)) & (size <= t["n"] * F.lit(high)))
        dice = F.transform(fitting, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(s["grams"], t["grams"])) / (size + t["n"])).alias("dice"), t["name"].alias("name"), s["line"].alias("line")))
        return F.array_min(F.transform(F.filter(dice, lambda d: d["dice"] >= min_dice), lambda d: F.struct((-d["dice"]).alias("minus"), d["name"].alias("name"), d["line"].alias("line"))))

    found = few.select("doc_id", "n_lines", F.transform(grams, compare).alias("by_segment"), "windows")
    found = found.withColumn("segments", F.filter("by_segment", lambda x: x.isNotNull()))
    touches = lambda h, w: (h["line"] >= w["line"]) & (h["line"] <= w["last"])
    same = lambda h, w: (h["line"] == 0) & (h["name"] == w["name"])
    found = found.withColumn("more", F.filter("windows", lambda w: ~F.exists("segments", lambda h: same(h, w) | touches(h, w) & (h["minus"] <= w["minus"]))))
    left = F.filter("segments", lambda h: ~F.exists("more", lambda w: touches(h, w)))
    found = found.withColumn("hits", F.concat(left, F.transform("more", lambda w: F.struct(w["minus"].alias("minus"), w["name"].alias("name"), w["line"].alias("line")))))
    return found.withColumn("first", F.array_min("hits")).select(
        "doc_id",
        "n_lines",
        F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long").alias("n_segments"),
        F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.transform("hits", lambda d: d["name"]))), ","), F.lit("")).alias("licenses"),
        F.col("first.name").alias("best_license"),
        F.round(-F.col("first.minus"), 6).alias("best_dice"),
        F.col("first.line").cast("long").alias("best_line"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_sql() -> str:
    """The same scan in DuckDB's dialect."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({quoted(name)}, [{', '.join(map(quoted, g))}])" for name, g in _templates())
    low, high = MIN_DICE / (2 - MIN_DICE), (2 - MIN_DICE) / MIN_DICE
    return f"""
WITH t(name, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT row_id, unnest(string_split(text, chr(10))) AS segment, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM d),
parts AS (SELECT row_id, unnest(regexp_split_to_array(text, '\\n[\\x09-\\x0D\\x20]*\\n')) AS segment FROM d),
segments AS (
  SELECT row_id, line, 'l' || CAST(line AS VARCHAR) AS seg, segment FROM lines
  UNION ALL SELECT row_id, 0, 'p' || CAST(row_number() OVER () AS VARCHAR), segment FROM parts WHERE contains(segment, chr(10))
),
words AS (SELECT row_id, line, seg, string_split(trim(regexp_replace(lower(segment), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ') AS w FROM segments),
grams AS (SELECT row_id, line, seg, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM words WHERE len(w) >= 3),
found AS (
  SELECT row_id, line, seg, name, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice
  FROM grams JOIN t ON len(g) >= len(t.grams) * {low!r}::DOUBLE AND len(g) <= len(t.grams) * {high!r}::DOUBLE
),
best AS (SELECT *, row_number() OVER (PARTITION BY row_id, seg ORDER BY dice DESC, name) AS place FROM found WHERE dice >= {MIN_DICE}::DOUBLE),
hit AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dice DESC, name, line) AS rank FROM best WHERE place = 1),
per AS (
  SELECT row_id, CAST(count(DISTINCT seg) AS BIGINT) AS n_segments, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
    max(CASE WHEN rank = 1 THEN name END) AS best_license, round(max(dice), 6) AS best_dice, CAST(max(CASE WHEN rank = 1 THEN line END) AS BIGINT) AS best_line
  FROM hit GROUP BY row_id
)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, coalesce(n_segments, 0) AS n_segments, coalesce(licenses, '') AS licenses, best_license, best_dice, best_line
FROM d LEFT JOIN per USING (row_id)
"""
