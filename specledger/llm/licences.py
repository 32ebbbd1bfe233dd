"""Licence notices by Dice coefficient over word bigrams (operator 7). DataFrame functions only.

Units of a document are its lines and its whole text. A unit and the templates are normalised (lower case, everything but letters and digits is
a blank) and compared by their sets of word bigrams: Dice = 2 |common| / (|unit| + |template|). A Dice of ``least`` needs sizes within a factor
of (2 - least) / least, so units too long or too short for all templates are dropped before their bigrams are made, and each unit meets
only the templates of fitting size. The templates are a list in the code of the caller and are matched inside each row: nothing is shuffled.

Defined results: null, blank and one-word units have no bigrams and match nothing; of equally similar templates the first by name wins; repeated
rows are reported as often as they occur. Other columns than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Short forms in which licences are named in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
LEAST = 0.8


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def unit_bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                        lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id``, ``licence`` and ``similarity`` of the best unit (null if none), and ``n_units``, the units that match."""
    factor = (2 - least) / least
    grams = {name: bigrams(text) for name, text in sorted(templates.items())}
    if not any(grams.values()):
        raise ValueError("no template has a bigram")
    sizes = [len(g) for g in grams.values() if g]
    fewest, most = min(sizes) / factor, max(sizes) * factor
    table = F.array(*[F.struct(F.lit(len(g)).alias("n"), F.lit(-rank).alias("rank"), F.lit(name).alias("name"),
                               F.array(*[F.lit(x) for x in g]).alias("grams")) for rank, (name, g) in enumerate(grams.items()) if g])
    # A text of more words than lines of the longest template could hold can only match line by line. Repeated bigrams count once, so the
    # number of words bounds the size from above only; units below the lower bound go.
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.array("text")))
    cut = docs.select("doc_id", F.explode(F.array(F.transform(units, normal_words))).alias("_w"))
    small = cut.select("doc_id", F.explode(F.array(F.filter("_w", lambda w: F.size(w) - 1 >= fewest))).alias("_w"))
    made = small.select("doc_id", F.explode(F.array(F.filter(F.transform("_w", unit_bigrams), lambda g: F.size(g).between(fewest, most)))).alias("_g"))
    dice = lambda g, t: F.round(2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"]), 9)
    best = F.transform("_g", lambda g: F.array_max(F.transform(
        F.filter(table, lambda t: (t["n"] <= F.size(g) * factor) & (F.size(g) <= t["n"] * factor)),
        lambda t: F.struct(dice(g, t).alias("similarity"), t["rank"].alias("rank"), t["name"].alias("name")))))
    scored = made.select("doc_id", F.explode(F.array(F.filter(best, lambda b: b["similarity"] >= least))).alias("_b"))
    top = F.array_max("_b")
    return scored.select("doc_id", top["name"].alias("licence"), top["similarity"].alias("similarity"), F.size("_b").alias("n_units"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    values = ", ".join("('{}', {}, [{}])".format(name, -rank, ", ".join(f"'{g}'" for g in bigrams(text)))
                       for rank, (name, text) in enumerate(sorted(templates.items())))
    return f"""
with templates(name, rank, grams) as (values {values}),
units as (select doc_id, unnest(list_distinct(list_append(string_split(text, chr(10)), text))) as unit from documents),
words as (select doc_id, list_filter(string_split(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') as w from units),
grams as (select doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as g from words where len(w) between 2 and 10000),
scored as (select doc_id, row_number() over () as unit_no, g, name, rank, round(2 * len(list_intersect(g, grams)) / (len(g) + len(grams)), 9) as similarity
  from grams join templates on len(g) between len(grams) * {least / (2 - least)!r} and len(grams) * {(2 - least) / least!r}),
hits as (select * from scored where similarity >= {least}),
best as (select doc_id, arg_max(name, struct_pack(a := similarity, b := rank)) as licence, max(similarity) as similarity, count(distinct g) as n_units
  from hits group by doc_id)
select d.doc_id as doc_id, licence, similarity, coalesce(n_units, 0)::int as n_units from documents d left join best b on b.doc_id = d.doc_id"""
