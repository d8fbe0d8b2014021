"""License scans by a positional index of rare words, with DataFrame functions only.

The words of the licence phrases and templates get their document frequencies from the whole table. A template matches at a place if nearly
all of its words stand at their relative positions; `d` of them may differ, so the d + 1 words of highest IDF are indexed, one of which
stands where it should in every match. Where an indexed word stands in a file, the template's start follows from its offset; postings that
agree on a start are one candidate, whose words are counted, and which then must hold the template's key phrases: two versions of
a licence differ in little else. All of it happens within a row, so nothing is shuffled but the frequencies of some hundred words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import _session as S

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further labels: a template's words, and the phrases that must stand within it however many of its words agree.
TEMPLATES = (
    ("gnu general public license version 2", "gpl-2.0", ("version 2",)),
    ("gnu general public license version 3", "gpl-3.0", ("version 3",)),
    ("gnu lesser general public license", "lgpl", ("lesser general",)),
    ("gnu affero general public license", "agpl", ("affero general",)),
    ("apache license version 2 0", "apache-2.0", ("version 2 0",)),
    ("cc by 4 0", "cc-by-4.0", ("cc by",)),
    ("cc by sa 4 0", "cc-by-sa-4.0", ("cc by sa",)),
    ("cc by nc 4 0", "cc-by-nc-4.0", ("cc by nc",)),
    ("cc by nd 4 0", "cc-by-nd-4.0", ("cc by nd",)),
    ("released under the mit license", "mit-release", ("mit license",)),
    ("mozilla public license", "mpl", ("mozilla public license",)),
    ("eclipse public license", "epl", ("eclipse public license",)),
    ("bsd 3 clause", "bsd-3-clause", ("bsd 3 clause",)),
    ("boost software license", "bsl-1.0", ("boost software license",)),
    ("isc license", "isc", ("isc license",)),
    ("creative commons zero", "cc0", ("commons zero",)),
    ("all rights reserved", "proprietary", ("all rights reserved",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text", ("free of charge",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ("source and binary forms",)),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0", ("apache license", "version 2 0")),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     "gpl-2.0", ("gnu general public license", "version 2 of")),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     "gpl-3.0", ("gnu general public license", "version 3 of")),
    ("it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     "lgpl", ("lesser general public license",)),
    ("it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     "agpl", ("affero general public license",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", ("mozilla public license",)),
    ("the accompanying materials are made available under the terms of the eclipse public license", "epl", ("eclipse public license",)),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", ("commons attribution 4 0",)),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0", ("attribution sharealike 4 0",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("with or without fee",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("public domain",)),
)
#: Words of a template that may differ: a fifth, from this many words.
EXACT_BELOW = 10
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text that isn't null, A-Z as a-z."""
    spaced = F.btrim(F.regexp_replace(text, _BETWEEN, " "), F.lit(" "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(F.translate(spaced, _UPPER, _LOWER), " "))


def _array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def may_differ(template: str) -> int:
    n = len(template.split())
    return 0 if n < EXACT_BELOW else n // 5


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and labels of every text.

    Returns doc_id, n_words, n_base (places of all base phrases), first_word and last_word (smallest and largest start
    of one, words from 0; null without any), base_labels, labels (those and the templates'; distinct, sorted, joined by
    commas; empty without any) and score: w / (w + 1) for the w words of the longest phrase or template that gave a label, 0 without
    one. A template of ten words or more may differ in a fifth of them at its place, missing ones at the end of a text included, if its key phrases
    stand there. Null texts are empty. One row per input row, ties and repeats included; an empty table gives an empty one.
    Other columns are ignored.
    """
    vocabulary = sorted({w for p in (*BASE, *(t for t, _, _ in TEMPLATES)) for w in p.split()})
    rows = S.documents(docs).withColumn("words", words(F.col("text"))).select("doc_id", "words")
    counted = rows.select(F.explode(F.array_intersect("words", _array(vocabulary))).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}  # no more rows than the vocabulary
    total = sum(frequency.values()) + 1
    idf = {w: math.log(total / (frequency.get(w, 0) + 0.5)) for w in vocabulary}

    def indexed(template: str, n: int) -> list[tuple[int, str]]:
        """The n words of highest IDF with their offsets."""
        return sorted(enumerate(template.split()), key=lambda x: (-idf[x[1]], x[0]))[:n]

    wanted = {t: indexed(t, may_differ(t) + 1) for t in (*BASE, *(t for t, _, _ in TEMPLATES))}
    keys = sorted({w for pairs in wanted.values() for _, w in pairs})
    # the index: places of the rare words only, as (place, word)
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(_array(keys), w), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    found = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", _array(keys)), F.col("words")).alias("words"))
    found = found.select("doc_id", "n_words", "words", F.when(F.col("words").isNotNull(), places).alias("places"))

    def starts(template: str, phrases: tuple = ()) -> Column:
        """Places where a template begins: postings by relative position, agreeing words counted, key phrases looked for."""
        ws, offsets = template.split(), {}
        for at, w in wanted[template]:
            offsets.setdefault(w, []).append(at)
        needed = len(ws) - may_differ(template)

        def posted(word: str, at: int) -> Column:
            return F.transform(F.filter("places", lambda x: x["word"] == word), lambda x: x["at"] - at)

        def agree(s: Column) -> Column:
            return F.size(F.filter(_numbered(ws), lambda y: F.get("words", s + y["at"]) == y["word"])) >= needed

        def within(found_: Column, phrase: list[str]) -> Column:
            last = len(ws) - len(phrase)
            return F.filter(found_, lambda s: F.exists(F.sequence(s, s + last), lambda i: F.slice("words", i + 1, len(phrase)) == _array(phrase)))

        here = F.filter(F.array_distinct(F.concat(*(posted(w, at) for w, ats in offsets.items() for at in ats))), lambda s: (s >= 0) & agree(s))
        for p in phrases:
            here = within(here, p.split())
        return F.coalesce(F.transform(here, lambda s: s.cast("long")), F.array().cast("array<long>"))

    base = {p: f"b{i}" for i, p in enumerate(BASE)}
    marks = [(t, label, f"t{i}") for i, (t, label, _) in enumerate(TEMPLATES)]
    looked = [starts(p).alias(n) for p, n in base.items()] + [(F.size(starts(t, keys_)) > 0).alias(f"t{i}") for i, (t, _, keys_) in enumerate(TEMPLATES)]
    found = found.select("doc_id", "n_words", *looked)
    all_ = F.concat(*base.values())
    hits = [(F.size(n) > 0, BASE[p], len(p.split())) for p, n in base.items()] + [(F.col(n), label, len(t.split())) for t, label, n in marks]
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(hit, F.lit(label)) for hit, label, _ in hits)))))
    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(n) > 0, F.lit(BASE[p])) for p, n in base.items()))))
    best = F.greatest(*(F.when(hit, F.lit(float(n))).otherwise(0.0) for hit, _, n in hits))
    return found.select(
        S.public_id(), "n_words", F.size(all_).cast("long").alias("n_base"), F.array_min(all_).alias("first_word"), F.array_max(all_).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        (best / (best + F.lit(1.0))).alias("score"),
    )


def _numbered(ws: list[str]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in enumerate(ws)))
