"""License scans: a trained paragraph classifier over word n-grams, confirmed against templates. DataFrame operations only.

One-against-the-rest logistic regressions, one per licence family and one for licence text of any kind, over the n-grams
of a paragraph that hold a word of licences (`CUES`). A paragraph without such an n-gram has no feature, so leaving it
out before anything else is done loses nothing. Longer texts only add n-grams, never weigh others down.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.text import let
from veriloom.llm.rows import ROW, named, packed
from veriloom.session import materialised

_CC = {"cc-by": "by", "cc-by-sa": "by sa", "cc-by-nd": "by nd", "cc-by-nc": "by nc", "cc-by-nc-sa": "by nc sa", "cc-by-nc-nd": "by nc nd"}
_CC_WORDS = {"by": "Attribution", "sa": "ShareAlike", "nd": "NoDerivatives", "nc": "NonCommercial"}
#: Names of public licences by family, as SPDX and common use write them.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("AGPL-3.0", "AGPLv3", "GNU Affero General Public License"),
    "apache": ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0"),
    "boost": ("BSL-1.0", "Boost Software License"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "BSD License", "BSD licence", "BSD-style license"),
    "cc0": ("CC0-1.0", "CC0 1.0 Universal", "CC0"),
    **{f: (*(f"CC {c} {v}".upper() for c in (code,) for v in ("4.0", "3.0", "2.0")), f"CC {code.upper()} license") for f, code in _CC.items()},
    "epl": ("EPL-2.0", "EPL-1.0", "Eclipse Public License"),
    "eupl": ("EUPL-1.2", "EUPL-1.1", "European Union Public Licence", "European Union Public License"),
    "gpl": ("GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GPL v3", "GPL v2", "GNU GPL", "GNU General Public License"),
    "isc": ("ISC License", "ISC licence"),
    "lgpl": ("LGPL-2.1", "LGPL-3.0", "LGPLv2", "LGPLv3", "GNU LGPL", "GNU Lesser General Public License", "GNU Library General Public License"),
    "mit": ("MIT License", "MIT licence", "MIT-style license"),
    "mpl": ("MPL-2.0", "MPL-1.1", "MPL 2.0", "Mozilla Public License"),
    "unlicense": ("Unlicense",),
    "wtfpl": ("WTFPL",),
    "zlib": ("zlib License",),
}
#: Grants and conditions of public licences, paragraph by paragraph.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "boost": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    **{f: (f"This work is licensed under a Creative Commons {'-'.join(_CC_WORDS[c] for c in code.split())} 4.0 International License",) for f, code in _CC.items()},
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "wtfpl": ("Do What The Fuck You Want To Public License",),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",),
}
FAMILIES = tuple(sorted(NAMES))
#: How grants name a licence; in the second row, and of a name that stands alone, only names of two words or more, and MIT.
_CARRIERS = ("released under the {}", "licensed under the {}", "licensed under {}", "distributed under {}", "this project is licensed under the terms of the {}", "SPDX-License-Identifier: {}", "license: {}", "under the {}")
#: What training calls licence text of no known family.
_UNKNOWN_TEXTS = (
    "All rights reserved.", "Copyright by the author. All rights reserved.", "Copyright (c) 2020 A. Person", "Licensed under terms that are not stated here", "All rights reserved by the author",
    "Please contact us for a commercial license", "Released under a proprietary license", "This software is licensed under the terms of the end user license agreement", "See the LICENSE file for license terms",
    "license", "licensed", "License terms may change", "Copyright notice", "No part of this work may be copied without permission of the copyright holder", "Licence to be decided", "This work is licensed to you, not sold",
    "Redistribution is not permitted", "copyright reserved", "the license of this file is unknown", "Provided without warranty of any kind", "by permission of the publisher, all rights reserved",
)
#: Texts with words of licences that are no licences.
_OTHER_TEXTS = (
    "You need a license to drive a car in this country", "His driver's licence was taken away", "The driving licence office is closed on Mondays", "A fishing license may be obtained from the ministry",
    "The copyright office opened a new building", "An Apache helicopter landed near the town", "the Apache people of the plains", "an Apache server", "permission was granted by the city to build", "permission was granted to modify the binary",
    "He asked for her permission to leave", "The seat was reserved for the guest", "a reserved man of few words", "the domain of the king", "a table reserved by the window", "the public domain of the park was granted to the town",
    "the house of commons met on Friday", "they own the commons together", "the attribution of the painting is open", "The gnu is an animal of the plains", "the Mozilla browser was installed", "hereby we tell you that the shop is closed", "the warranty of the car ends in May", "a warrant was issued for his arrest",
    "The file was released under the name of the author", "Released under the title of the first album", "the wine was obtained from a licensed shop", "a licensed pilot flew the plane", "the licensed premises close at ten", "poetic licence", "artistic license was taken with the story",
    "the eclipse public viewing takes place at noon", "the rights were granted to the miners", "a grant was given for obtaining books", "domain name", "boost the software sales", "she was granted leave", "the bank granted him a loan", "mit dem Auto und mit Freunden", "er kam mit den anderen", "a lecture at MIT", "das Haus mit or und mit and an", "the license fee was paid by the viewers",
    "students of MIT and others met", "the license plate of the car", "his license to practise medicine", "licensed taxi drivers", "the permission slip was signed", "No permission needed to enter the park", "obtaining a copy of the key is easy",
)
LICENCE, UNKNOWN = "licence", "unknown"
#: N-grams with one of these are features: parts of words, and whole words or runs of words.
STEMS = tuple(
    "licen copyright reserved spdx apache mozilla commons domain redistribut permission permitted hereby granted obtaining warrant unencumbered attribution noncommercial sharealike "
    "noderivatives wtfpl zlib eupl gpl bsd".split()
)
RUNS = ("gnu", "mpl", "epl", "bsl", "isc", "cc by", "cc 0", "cc zero", "cc0", "under mit", "under the mit", "mit or", "mit and", "mit gplv2", "mit gplv3", "mit apache", "mit x11", "or mit", "and mit", "identifier mit")
#: The same as a regular expression over normal words, one space apart ("cc by nc" is one word there, see `_normal`), and of RUNS
#: over lower-case text, where any one of their first three words is.
CUES = f"{'|'.join(STEMS)}|(?:^| )(?:{'|'.join(r.replace('cc by', 'ccby[a-z]*') for r in RUNS)})(?: |$)"
_RUN_IN_TEXT = f"(?<![a-z0-9])(?:{'|'.join(r.replace(' ', '[^a-z0-9]+') for r in RUNS)})(?![a-z0-9])"
_RUN_PARTS = ("gnu", "mpl", "epl", "bsl", "isc", "cc", "mit")
#: Longest word n-gram; share of a template's n-grams that confirms a prediction (names have to be whole); least probability of a family.
N_MAX, CONFIRM, CERTAIN = 3, 0.7, 0.5
#: Weight of the absolute penalty, which makes the model sparse; one training row in HELD_OUT is kept for the calibration.
PENALTY, HELD_OUT, STEPS = 0.1, 4, 300
#: Comment marks that are words.
_COMMENT = r"(?i)^\s*(?:dnl|rem)\s"
#: The parts of a Creative Commons code make one word.
_GLUE = ((r"\bcc by\b", "ccby"), (r"\bccby nc\b", "ccbync"), (r"\b(ccby|ccbync) (sa|nd)\b", "{1}{2}"))


def _words(text: str) -> list[str]:
    norm = " ".join(re.findall("[a-z0-9]+", text.lower()))
    for pattern, whole in _GLUE:
        norm = re.sub(pattern, re.sub(r"\{(\d)\}", r"\\\1", whole), norm)
    return norm.split()


def _grams(tokens: list[str]) -> list[str]:
    return sorted({" ".join(tokens[i : i + n]) for n in range(1, N_MAX + 1) for i in range(len(tokens) - n + 1)})


def training_rows(seed: int = 5) -> list[tuple[list[str], frozenset[str]]]:
    """(words, classes) of texts made from the names and templates: each in the ways that grants use it, whole and cut at
    either end, and two licences together; licence texts of no family; and other texts. Cuts to a quarter of a template
    that do not name it are of no family."""
    rng, rows = random.Random(seed), []
    named = {f: [*NAMES[f], *(["MIT"] if f == "mit" else [])] for f in FAMILIES}
    for family, names in named.items():
        for name in names:
            rows += [(c.format(name), {family}) for c in _CARRIERS]
            rows += [(name, {family})] * 2 if name != "MIT" else []
        for template in TEMPLATES.get(family, ()):
            tokens = _words(template)
            n = len(tokens)
            for size in sorted({n, int(0.9 * n), int(0.75 * n), int(0.6 * n), n // 4}):
                for start in range(0, n - size + 1, 1 if size >= 0.9 * n else 2):
                    cut = " ".join(tokens[start : start + size])
                    sure = size >= 0.6 * n or any(f" {' '.join(_words(name))} " in f" {cut} " for name in names)
                    rows.append((cut, {family} if sure else set()))
            rows += [(template, {family})] * 4
    forms = ("{} or {}", "dual licensed under {} and {}", "dual {}/{}", "SPDX-License-Identifier: {} OR {}", "released under the {} or the {}")
    for _ in range(300):
        a, b = rng.sample(FAMILIES, 2)
        rows.append((rng.choice(forms).format(rng.choice(named[a]), rng.choice(named[b])), {a, b}))
    for other in (f for f in FAMILIES if f != "mit"):  # its name alone is the only one of one common word
        for form in forms:
            for name in named[other]:
                rows += [(form.format("MIT", name), {"mit", other}), (form.format(name, "MIT"), {"mit", other})]
    texts = [(f, t) for f, held in TEMPLATES.items() for t in held]
    for _ in range(200):
        (a, one), (b, two) = rng.sample(texts, 2)
        rows.append((f"{one} | {two}", {a, b}))
    out = [(_words(t), frozenset({*classes, LICENCE} if classes else ())) for t, classes in rows]
    # Short cuts of a template are licence text where they hold a cue, whatever family they are of: left to the other classes.
    out = [(w, c) for w, c in out if c or re.search(CUES, " ".join(w))]
    out = [(w, c or frozenset({LICENCE})) for w, c in out]
    out += [(_words(t), frozenset({LICENCE})) for t in _UNKNOWN_TEXTS for _ in range(4)]
    return out + [(_words(t), frozenset()) for t in _OTHER_TEXTS for _ in range(6)]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of logistic regressions with an absolute penalty, by accelerated proximal gradients."""
    v = np.ones(x.shape[1] + 1)
    one = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(30):
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    step = 4 / float(np.linalg.norm(one @ v) ** 2)
    w = ahead = np.zeros((one.shape[1], y.shape[1]))
    t = 1.0
    for _ in range(STEPS):
        new = ahead - step * (one.T @ (1 / (1 + np.exp(-np.clip(one @ ahead, -30, 30))) - y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], w[-1]


def _matrix(rows: list[tuple[list[str], frozenset[str]]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    classes = (*FAMILIES, LICENCE)
    x, y = np.zeros((len(rows), len(vocabulary))), np.zeros((len(rows), len(classes)))
    for i, (tokens, held) in enumerate(rows):
        x[i, [vocabulary[g] for g in _grams(tokens) if g in vocabulary]] = 1
        y[i, [classes.index(c) for c in held]] = 1
    return x, y


@lru_cache(maxsize=1)
def trained() -> tuple[dict[tuple[str, str], float], dict[str, float]]:
    """(weights by (class, n-gram), intercepts by class). A fit on three rows in four gives the temperature that makes the
    others most likely; the model is the fit on all rows with its logits divided by it. The same in every run."""
    rows = training_rows()
    order = random.Random(7).sample(range(len(rows)), len(rows))
    vocabulary = {g: i for i, g in enumerate(sorted({g for tokens, _ in rows for g in _grams(tokens) if re.search(CUES, g)}))}
    x, y = _matrix(rows, vocabulary)
    kept, held = order[len(rows) // HELD_OUT :], order[: len(rows) // HELD_OUT]
    w, b = _fit(x[kept], y[kept])
    z = x[held] @ w + b

    def loss(temperature: float) -> float:
        return float(np.logaddexp(0, np.where(y[held] > 0, -z, z) / temperature).sum())

    temperature = min((round(0.25 + 0.05 * i, 2) for i in range(76)), key=loss)
    w, b = _fit(x, y)
    classes = (*FAMILIES, LICENCE)
    weights = {(classes[c], g): round(float(w[i, c]) / temperature, 4) for g, i in vocabulary.items() for c in np.flatnonzero(np.abs(w[i]) >= 0.005)}
    # Without a feature, no class is reached.
    start = {c: min(round(float(b[i]) / temperature, 4), -0.01) for i, c in enumerate(classes)}
    return weights, start


def template_grams() -> list[tuple[str, str, str, float, float]]:
    """(family, template, n-gram, n-grams in all, least share): names and templates; MIT's name is too short to be one."""
    out = []
    for family in FAMILIES:
        for kind, texts, least in (("name", NAMES[family], 1.0), ("text", TEMPLATES.get(family, ()), CONFIRM)):
            for i, text in enumerate(texts):
                grams = _grams(_words(text))
                out += [(family, f"{family}-{kind}-{i}", g, float(len(grams)), least) for g in grams]
    for i, run in enumerate(("under mit", "under the mit", "identifier mit", "or mit", "mit or", "mit gplv2", "mit apache", "license mit")):
        out.append(("mit", f"mit-run-{i}", run, 1.0, 1.0))
    return out


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table, as SQL values."""
    return spark.sql(f"SELECT * FROM VALUES {_values(rows, lambda v: f'CAST({v!r} AS DOUBLE)')} AS t({', '.join(names)})")


def _values(rows: list[tuple], number) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else number(v)
    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def _normal(text: Column) -> Column:
    norm = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    for pattern, whole in _GLUE:
        norm = F.regexp_replace(norm, pattern, re.sub(r"\{(\d)\}", r"$\1", whole))
    return norm


def has_cue(text: Column) -> Column:
    """Whether a text can hold a cue: most do not, and plain searches tell."""

    def of_lower(low: Column) -> Column:
        stem = reduce(lambda a, b: a | b, [low.contains(x) for x in STEMS])
        return stem | (reduce(lambda a, b: a | b, [low.contains(x) for x in _RUN_PARTS]) & low.rlike(_RUN_IN_TEXT))

    return let(F.lower(text), of_lower)


def _list(words: Iterable[str]) -> Column:
    return F.split(F.lit("|".join(sorted(words))), r"\|")


def _all_grams(norm: Column) -> Column:
    """Distinct word n-grams; the tokens are bound once and read by position, as a paragraph may be long."""

    def of_length(tokens: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: i + n <= F.size(tokens))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[tokens[i + k] for k in range(n)]))

    def of_tokens(tokens: Column) -> Column:
        return F.array_distinct(F.concat(*[of_length(tokens, n) for n in range(1, N_MAX + 1)]))

    return let(F.split(norm, " "), of_tokens)


def paragraphs(held: DataFrame) -> DataFrame:
    """(ROW, paragraph, norm) of the paragraphs with a cue of rows (ROW, text): runs of lines that have letters or digits, numbered
    by their first line (from 0), as lower-case words. Texts without a cue are left where they are read."""
    held = held.where(has_cue(F.col("text")))
    marked = lambda x, i: F.concat(F.lit("\2"), i.cast("string"), F.lit("\3"), F.regexp_replace(F.translate(x, "\1\2\3", ""), _COMMENT, " "))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), marked(x, i)).otherwise(F.lit("\1")))
    parts = held.select(ROW, F.explode(F.split(F.array_join(lines, "\n"), "\1")).alias("part")).where("part <> ''")
    number = F.regexp_extract("part", "\2(\\d+)\3", 1).cast("int")
    return parts.select(ROW, number.alias("paragraph"), _normal(F.regexp_replace("part", "\2\\d+\3", "")).alias("norm")).where(F.col("norm").rlike(CUES))


def _classified(norms: DataFrame) -> DataFrame:
    """(a, b, family, probability, similarity, confirmed) of distinct paragraphs (a, b: two hashes; norm)."""
    spark = norms.sparkSession
    weights, start = trained()
    templates = template_grams()
    known = {g for _, g in weights} | {g for _, _, g, _, _ in templates}
    grams = materialised(norms.select("a", "b", F.explode(F.array_intersect(_all_grams(F.col("norm")), _list(known))).alias("gram")))
    model = _rows(spark, [(f, g, w) for (f, g), w in weights.items()], ["family", "gram", "w"])
    begin = _rows(spark, list(start.items()), ["family", "start"])
    z = grams.join(F.broadcast(model), "gram").groupBy("a", "b", "family").agg(F.sum("w").alias("z")).join(F.broadcast(begin), "family")
    p = materialised(z.select("a", "b", "family", (1 / (1 + F.exp(-(F.col("z") + F.col("start"))))).alias("p")).where(F.col("p") >= CERTAIN))
    found = p.where(F.col("family") != LICENCE)
    other = p.where(F.col("family") == LICENCE).join(found.select("a", "b"), ["a", "b"], "left_anti").withColumn("family", F.lit(UNKNOWN))
    known_rows = _rows(spark, templates, ["family", "template", "gram", "n", "least"])
    share = (F.count("*") / F.max("n")).alias("s")
    shares = grams.join(F.broadcast(known_rows), "gram").groupBy("a", "b", "family", "template", "least").agg(share).where(F.col("s") >= F.least("least", F.lit(CONFIRM)))
    best = shares.where((F.col("least") < 1) | (F.col("s") >= 1)).groupBy("a", "b", "family").agg(F.round(F.max("s"), 4).alias("similarity"))
    out = found.unionByName(other).join(best, ["a", "b", "family"], "left")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return out.select("a", "b", "family", F.round("p", 4).alias("probability"), similarity.alias("similarity"), (similarity >= CONFIRM).alias("confirmed"))


def scan(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(`keep`, paragraph, family, probability, similarity, confirmed): for every paragraph of licence text a row for each
    family of CERTAIN probability, or one of family "unknown" if there is none.

    similarity is the greatest share of a template's n-grams, of that family, that the paragraph holds, from CONFIRM on
    (0 below; names count if they are held whole); confirmed says whether there is one. Texts are read once; each
    distinct paragraph is classified once, so a grant that a third of the documents share costs one classification. Null
    and empty texts have no paragraph; repeated rows are reported each; an empty table gives an empty result; columns of
    `keep` with the names of the result's are left out. The model's size depends on names and templates alone.
    """
    added = ("paragraph", "family", "probability", "similarity", "confirmed")
    kept = [c for c in dict.fromkeys(keep) if c not in added]
    rows = paragraphs(documents.select(packed(kept), named(text).alias("text")))
    rows = materialised(rows.withColumns({"a": F.xxhash64("norm"), "b": F.xxhash64(F.lit(1), "norm")}))
    labels = _classified(rows.select("a", "b", "norm").dropDuplicates(["a", "b"]))
    return rows.drop("norm").join(labels, ["a", "b"]).select(*[F.col(ROW).getField(c).alias(c) for c in kept], *added)


def scan_sql(table: str = "documents") -> str:
    """DuckDB SQL for `scan` with the fitted weights as values; it looks at every paragraph's words, not at texts first."""
    weights, start = trained()
    number = lambda v: f"{v!r}::DOUBLE"
    norm = "array_to_string(regexp_extract_all(lower(p), '[a-z0-9]+'), ' ')"
    for pattern, whole in _GLUE:
        norm = f"regexp_replace({norm}, '{pattern}', '{re.sub(r'{(.)}', chr(92) * 2 + chr(92) + '1', whole)}', 'g')"
    of_n = " || ".join(f"[array_to_string(t[i:i+{n - 1}], ' ') FOR i IN range(1, len(t) + 2 - {n})]" for n in range(1, N_MAX + 1))
    return f"""
WITH model(family, gram, w) AS (VALUES {_values([(f, g, w) for (f, g), w in weights.items()], number)}), start(family, b) AS (VALUES {_values(list(start.items()), number)}),
templates(family, template, gram, n, least) AS (VALUES {_values(template_grams(), number)}),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM (SELECT row_number() OVER () AS r, doc_id, text FROM {table})),
marked AS (SELECT doc_id, text, i, line, regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS full_, i - row_number() OVER (PARTITION BY doc_id, text, regexp_matches(line, '[\\p{{L}}\\p{{N}}]') ORDER BY i) AS run FROM lines),
paras AS (SELECT doc_id, min(i)::INT AS paragraph, string_agg(regexp_replace(line, '(?i)^\\s*(?:dnl|rem)\\s', ' '), chr(10) ORDER BY i) AS p FROM marked WHERE full_ GROUP BY doc_id, text, run),
normal AS (SELECT doc_id, paragraph, {norm} AS norm FROM paras),
found AS (SELECT * FROM normal WHERE regexp_matches(norm, '{CUES}')),
norms AS (SELECT DISTINCT norm, string_split(norm, ' ') AS t FROM found),
exploded AS (SELECT norm, unnest(list_distinct({of_n})) AS gram FROM norms),
z AS (SELECT norm, family, sum(w) AS z FROM exploded JOIN model USING (gram) GROUP BY ALL),
p AS (SELECT norm, family, 1 / (1 + exp(-(z + b))) AS p FROM z JOIN start USING (family)),
sure AS (SELECT * FROM p WHERE p >= {CERTAIN}),
labels AS (SELECT * FROM sure WHERE family <> '{LICENCE}' UNION ALL
  SELECT norm, '{UNKNOWN}', p FROM sure WHERE family = '{LICENCE}' AND norm NOT IN (SELECT norm FROM sure WHERE family <> '{LICENCE}')),
shares AS (SELECT norm, family, template, count(*) / max(n) AS s, max(least) AS least FROM exploded JOIN templates USING (gram) GROUP BY ALL),
best AS (SELECT norm, family, round(max(s), 4) AS similarity FROM shares WHERE s >= least GROUP BY ALL)
SELECT f.doc_id, f.paragraph, l.family, round(l.p, 4) AS probability, coalesce(b.similarity, 0.0) AS similarity, coalesce(b.similarity, 0.0) >= {CONFIRM} AS confirmed
FROM found f JOIN labels l USING (norm) LEFT JOIN best b ON b.norm = l.norm AND b.family = l.family"""
