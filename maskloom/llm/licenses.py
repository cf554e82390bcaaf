"""Licence scans with a positional rare-token index.

Templates are passages of licences with phrases that must be there. How rare each of their words is comes from all documents.
The index holds postings (template, position) of the rarest words of each template: so many that a passage of which LEAST_SCORE
of the words stand where they should holds PROPOSERS of them within SHIFT words of their places, whatever words are missing. Of
a document only its occurrences of index words are looked up, its words of highest IDF among the templates'. Each posting says
where the template would begin; the posting lists are intersected by that: only where PROPOSERS postings of one template agree,
give or take SHIFT words, the template is held against the document. A word of the template counts where the document has it
within the band of 2 * SHIFT alignments, so that words put in or left out move no more than they must. The score is the share of
the template's words that count; mandatory phrases are verified in the words around.

A base phrase is a template that must match in full: its two rarest words are in the index and must agree exactly.

A null text counts as empty. Each input row gives a row, repeated rows too. Of words that are equally rare the first by
alphabet is taken. Texts of any length are scanned whole. An empty table gives an empty one. Other columns are ignored,
whatever their names. Nothing is shuffled but the counts of the templates' words, a number for each word of a fixed list.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, let

#: What separates words; base phrases; passages of public licences with their mandatory phrases.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
GNU = "you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation either version {1} of the license or at your option any later version"
NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["hereby granted free of charge", "associated documentation files"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + NO_WARRANTY, ["copies or substantial portions", "without warranty of any kind"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code", "this list of conditions"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products", "prior written permission"]),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ["gnu general public license", "version 3"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", GNU.format("general", 3), ["gnu general public license", "version 3"]),
    ("gpl-2", "gnu general public license version 2 june 1991", ["gnu general public license", "version 2"]),
    ("gpl-2", GNU.format("general", 2), ["gnu general public license", "version 2"]),
    ("lgpl-3", GNU.format("lesser general", 3), ["gnu lesser general public license", "version 3"]),
    ("lgpl-2.1", GNU.format("lesser general", "2 1"), ["gnu lesser general public license", "version 2 1"]),
    ("agpl-3", GNU.format("affero general", 3), ["gnu affero general public license", "version 3"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["granted to anyone", "redistribute it freely"]),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["source code form", "compiled binary"]),
]
#: Identifiers of the SPDX list, as words, and the labels they stand for.
SPDX = {"mit": "mit", "apache 2 0": "apache-2", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3", "gpl 3 0": "gpl-3", "gpl 2 0": "gpl-2", "lgpl 3 0": "lgpl-3", "lgpl 2 1": "lgpl-2.1", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc0 1 0": "cc0", "isc": "isc", "zlib": "zlib", "bsl 1 0": "bsl-1.0", "unlicense": "unlicense"}
#: Share (%) of a passage's words that must be there; words by which alignments may differ; postings that must agree.
LEAST_SCORE, SHIFT, PROPOSERS = 70, 4, 2
PLACES = "array<struct<at:bigint,label:string,base:boolean,score:double>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def templates() -> list[tuple[str, list[str], list[str], bool]]:
    """label, words, mandatory phrases, whether it is a base phrase."""
    lead = "spdx license identifier "
    known = PASSAGES + [(label, lead + name, [lead + name]) for name, label in SPDX.items()]
    return [(label, phrase.split(), [phrase], True) for phrase, label in BASE.items()] + [(label, text.split(), phrases, False) for label, text, phrases in known]


def frequencies(words: DataFrame) -> dict[str, int]:
    """In how many of all documents each word of the templates stands: a number per word of a fixed list. words: one array column."""
    listed = sorted({w for _, ws, _, _ in templates() for w in ws})
    found = words.select(F.explode(F.array_intersect(F.col(words.columns[0]), F.array(*map(F.lit, listed)))).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(listed, 0) | {r["w"]: r["count"] for r in found}


def least_words(n: int) -> int:
    """How many of a passage's n words must be there."""
    return -(-n * LEAST_SCORE // 100)


def index(df: dict[str, int], n_docs: int) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Postings (template, position) of base phrases and of passages, of each the positions whose words have the highest IDF.

    A band is twice SHIFT wide, so of 2 * PROPOSERS - 1 postings in it PROPOSERS are within SHIFT of each other.
    """
    idf = {w: math.log((n_docs + 1) / (n + 1)) for w, n in df.items()}
    base: dict[str, list[tuple[int, int]]] = {}
    own: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _, is_base) in enumerate(templates()):
        rarest = sorted(range(len(words)), key=lambda q: (-idf[words[q]], words[q], q))
        most = 2 if is_base else len(words) - least_words(len(words)) + 2 * PROPOSERS - 1
        for q in rarest[:most]:
            (base if is_base else own).setdefault(words[q], []).append((t, q))
    return base, own


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best of a place that was verified, 1 for a
    base phrase, else 0), and places: at, label, base and score of each; at is the first word of a base phrase or of a band."""
    base = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    exact, near = index(frequencies(base.select("words")), docs.count())
    parts, rare = templates(), sorted({*exact, *near})
    far = 2 * SHIFT * -(-max(len(words) for _, words, _, _ in parts) // SHIFT)
    array = lambda xs: F.array(*map(F.lit, xs))
    words_table = F.array(*(array(words) for _, words, _, _ in parts))
    phrase_table = F.array(*(array([f" {p} " for p in phrases]) for _, _, phrases, _ in parts))
    label_table = array([label for label, _, _, _ in parts])

    def occurrences(words: Column) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())

    def alignments(hits: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
        """A number for each posting of each occurrence, in order: template * 2^40 + far + where the template would begin."""
        shifts = F.create_map(*(x for w, ps in postings.items() for x in (F.lit(w), F.array(*(F.lit((t << 40) + far - q) for t, q in ps)))))
        each = F.transform(hits, lambda h: F.transform(F.element_at(shifts, h["w"]), lambda s: s + h["i"]))
        return F.array_sort(F.flatten(F.filter(each, lambda x: x.isNotNull())))

    def agreed(als: Column, most: int) -> Column:
        """Those that the next PROPOSERS - 1 are within ``most`` of."""
        return F.filter(als, lambda a, j: F.coalesce(F.get(als, j + PROPOSERS - 1) - a <= most, F.lit(False)))

    def around(words: Column, begin: Column, end: Column) -> Column:
        first = F.greatest(begin, F.lit(0))
        return F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, F.greatest(end - first, F.lit(0))), " "), F.lit(" "))

    def exact_place(words: Column, a: Column) -> Column:
        def of(t: Column, s: Column) -> Column:
            there = F.slice(words, F.greatest(s, F.lit(0)) + 1, F.size(F.get(words_table, t))) == F.get(words_table, t)
            return F.when((s >= 0) & there, F.struct(s.cast("long").alias("at"), F.get(label_table, t).alias("label"), F.lit(True).alias("base"), F.lit(1.0).alias("score")))

        return let(F.shiftright(a, 40).cast("int"), lambda t: let((a % (1 << 40) - far).cast("int"), lambda s: of(t, s)))

    def near_place(words: Column, a: Column) -> Column:
        """a: template * 2^40 + band; a band holds the alignments from band * SHIFT on, 2 * SHIFT of them."""

        def held(s: Column) -> Callable[[Column, Column], Column]:
            begin = lambda q: F.greatest(s + q, F.lit(0))
            return lambda w, q: F.array_contains(F.slice(words, begin(q) + 1, F.greatest(s + q + 2 * SHIFT - begin(q), F.lit(0))), w)

        def of(t: Column, s: Column, wanted: Column) -> Column:
            there = F.size(F.filter(F.transform(wanted, held(s)), lambda x: x))
            phrases = let(around(words, s, s + F.size(wanted) + 2 * SHIFT), lambda x: F.forall(F.get(phrase_table, t), lambda p: x.contains(p)))
            place = lambda v: F.struct(F.greatest(s, F.lit(0)).cast("long").alias("at"), F.get(label_table, t).alias("label"), F.lit(False).alias("base"), v.alias("score"))
            return let(there, lambda n: F.when(n * 100 >= F.size(wanted) * LEAST_SCORE, F.when(phrases, place(n / F.size(wanted)))))

        start = (a % (1 << 40) * SHIFT - far).cast("int")
        return let(F.shiftright(a, 40).cast("int"), lambda t: let(start, lambda s: let(F.get(words_table, t), lambda wanted: of(t, s, wanted))))

    def bands(a: Column) -> Column:
        """The two bands that an alignment lies in."""
        band = F.floor(a % (1 << 40) / SHIFT).cast("long") + F.shiftleft(F.shiftright(a, 40), 40)
        return F.array(band - 1, band)

    def places(words: Column, hits: Column) -> Column:
        exactly = let(alignments(hits, exact), lambda als: F.transform(F.array_distinct(agreed(als, 0)), lambda a: exact_place(words, a)))
        nearly = let(alignments(hits, near), lambda als: F.transform(F.array_distinct(F.flatten(F.transform(agreed(als, SHIFT), bands))), lambda a: near_place(words, a)))
        return F.filter(F.concat(exactly, nearly), lambda p: p.isNotNull())

    none = F.array().cast(PLACES)
    found = lambda w: let(occurrences(w), lambda h: F.when(F.size(h) >= PROPOSERS, places(w, h)).otherwise(none).cast(PLACES))
    done = base.select("doc_id", let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("p"))).alias("x"))
    at = F.transform(F.filter("x.p", lambda p: p["base"]), lambda p: p["at"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return done.select(
        "doc_id", "x.n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(F.filter("x.p", lambda p: p["base"])).alias("base_labels"), labels(F.col("x.p")).alias("labels"),
        F.coalesce(F.array_max(F.transform("x.p", lambda p: p["score"])), F.lit(0.0)).alias("score"), F.col("x.p").alias("places"),
    )
