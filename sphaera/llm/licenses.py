"""License scans by a positional index of rare tokens.

Each template of a license notice is indexed by its rarest words (the highest inverse
document frequency over the templates) and their positions.  A file's words are looked up
there; postings of one template that agree on where the template would start are summed,
and a start that gathers enough of the template's rarity is reported if the file also holds
the template's mandatory key phrase.  Plain phrases give the base labels beside that.

DataFrame functions only.  The index is a constant of some hundred postings; it is looked up
within each row, so the text is read once and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Label, mandatory key phrase and template, in words of public license notices.
_NOTICES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)
#: Names by which a notice gives its license; each is its own key phrase.  {v} is 2 or 3.
_GPL = (
    "gnu general public license as published by the free software foundation either version {v}",
    "gnu general public license as published by the free software foundation version {v}",
    "gnu general public license version {v}",
    "gnu general public license v{v}",
    "gnu general public license v {v}",
    "gnu general public license gpl version {v}",
    "gnu general public license {v} 0",
    "version {v} of the gnu general public license",
    "gnu gpl version {v}",
    "gpl version {v}",
    "gpl v{v}",
    "gpl v {v}",
    "gplv{v}",
    "gpl {v} 0",
)
#: The parts of a full Creative Commons name, and what follows it: no name goes on there with a further part.
_CC = {
    "cc-by": ("",),
    "cc-by-nc": (" noncommercial", " non commercial"),
    "cc-by-sa": (" sharealike", " share alike"),
    "cc-by-nd": (" noderivatives", " noderivs", " no derivatives", " no derivs"),
    "cc-by-nc-sa": (" noncommercial sharealike", " non commercial share alike", " noncommercial share alike"),
    "cc-by-nc-nd": (" noncommercial noderivatives", " noncommercial noderivs", " non commercial no derivatives", " non commercial no derivs"),
}
_CC_ENDS = ("4 0", "3 0", "2 5", "2 0", "1 0", "international", "unported", "license", "licence")
_CC_SHORT = {"cc-by": tuple(f"cc by {v}" for v in _CC_ENDS), "cc-by-nd": ("cc by nd",), "cc-by-nc-sa": ("cc by nc sa",), "cc-by-nc-nd": ("cc by nc nd",)}
_NAMES = (
    *((f"gpl-{v}", p.format(v=v)) for v in (3, 2) for p in _GPL),
    *((label, f"creative commons attribution{part} {end}") for label, parts in _CC.items() for part in parts for end in _CC_ENDS),
    *((label, p) for label, phrases in _CC_SHORT.items() for p in phrases),
)
TEMPLATES = (*_NOTICES, *((label, p, p) for label, p in _NAMES))
#: Words of a template that are indexed, the words by which their places may be off, and the share of their rarity that must agree.
RARE, SLACK, COVERAGE = 6, 1, 0.6


def postings(templates: tuple = TEMPLATES, rare: int = RARE) -> list[tuple[str, int, int, float]]:
    """(word, template's number, position, weight): the rarest words of each template, their weights summing to 1."""
    words = [t.split() for _, _, t in templates]
    count = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log((1 + len(words)) / n) for w, n in count.items()}
    out = []
    for k, ws in enumerate(words):
        chosen = sorted(set(ws), key=lambda w: (-idf[w], ws.index(w)))[:rare]
        total = sum(idf[w] for w in chosen)
        out += [(w, k, ws.index(w), idf[w] / total) for w in chosen]
    return out


def _normal(lower: Column) -> Column:
    """The words of a lower-cased text with a space before and after each; a space for none.

    Letters other than A-Z are lower-cased as well, which no phrase or template here can
    tell, as none of them has a letter that another than A-Z becomes.
    """
    words = F.regexp_replace(lower, "[\\x00-/:-`{-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(words), F.lit(" "))))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _anchor_of() -> dict[str, str]:
    """phrase -> a word of it: of those over three letters, if any, the one in most phrases, then the longest; else the longest, letters before figures, then the first."""
    phrases = [p.split() for p, _ in BASE] + [p.split() for _, p, _ in TEMPLATES]
    count = Counter(w for p in phrases for w in set(p) if len(w) > 3)
    return {" ".join(p): max(p, key=lambda w: (len(w) > 3, count[w], len(w), w.isalpha())) for p in phrases}


def anchors() -> list[str]:
    """Words of which each phrase has one."""
    return sorted(set(_anchor_of().values()))


def _phrases(s: Column) -> Column:
    """The numbers of the templates whose key phrase stands in s; phrases are looked for where their anchor is found."""
    groups: dict[str, list[Column]] = {}
    anchor = _anchor_of()
    for k, (_, p, _) in enumerate(TEMPLATES):
        groups.setdefault(anchor[p], []).append(F.when(s.contains(f" {p} "), F.lit(k)))
    none = F.array().cast("array<int>")
    return F.flatten(F.array(*(F.when(s.contains(w), F.array_compact(F.array(*found))).otherwise(none) for w, found in groups.items())))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and s, the normal form of texts that hold an anchor, a space for others: only those can have a phrase."""
    lower = F.lower("text")
    some = F.lit(False)
    for w in anchors():
        some = some | F.col("lower").contains(w)
    rows = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("lower", lower)
    n_words = F.regexp_count("text", F.lit("[^\\x00-/:-@\\[-`{-\\x7F]+")).cast("long")
    return rows.select("doc_id", n_words.alias("n_words"), F.when(some, _normal(F.col("lower"))).otherwise(" ").alias("s"))


def base_labels(rows: DataFrame) -> DataFrame:
    """rows of _rows with n_base, first_word, last_word, base (array of labels)."""
    s = F.col("s")
    found = [s.contains(f" {p} ") for p, _ in BASE]
    counts = [F.when(x, F.regexp_count(s, F.lit(f" {p}(?= )")).cast("long")).otherwise(F.lit(0).cast("long")) for x, (p, _) in zip(found, BASE, strict=True)]
    firsts = [F.when(x, _spaces(F.substring_index(s, f" {p} ", 1))) for x, (p, _) in zip(found, BASE, strict=True)]
    lasts = [F.when(x, F.col("n_words") - _spaces(F.substring_index(s, f" {p} ", -1)) - len(p.split())) for x, (p, _) in zip(found, BASE, strict=True)]
    labels = F.array_compact(F.array(*(F.when(x, F.lit(label)) for x, (_, label) in zip(found, BASE, strict=True))))
    return rows.select("*", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), labels.alias("base"))


def _index() -> str:
    """The postings as a SQL array: for each template's number its (word, at, weight)."""
    held: dict[int, list[str]] = {}
    for w, k, at, weight in postings():
        held.setdefault(k, []).append(f"named_struct('word', '{w}', 'at', {at}, 'weight', {weight!r}D)")
    return "array(" + ", ".join("array(" + ", ".join(held[k]) + ")" for k in range(len(TEMPLATES))) + ")"


def template_labels(rows: DataFrame) -> DataFrame:
    """rows of _rows with found (array of labels) and coverage (null: none) of the templates that are confirmed.

    Within the row: where a posting's word stands gives the starts that its template may have;
    each start looks for the other postings at their places only, so a text's time is in
    proportion to its length.
    """
    index = _index()
    # the array of one struct binds the words, so that they are split once a row
    starts = f"flatten(transform({index}[t], p -> flatten(transform(filter(sequence(0, size(r.words) - 1), i -> r.words[i] = p.word), i -> sequence(i - p.at - {SLACK}, i - p.at + {SLACK})))))"
    near = f"slice(r.words, greatest(start + p.at - {SLACK}, 0) + 1, greatest(start + p.at + {SLACK} + 1 - greatest(start + p.at - {SLACK}, 0), 0))"
    coverage = f"aggregate({index}[t], 0D, (sum, p) -> sum + IF(array_contains({near}, p.word), p.weight, 0D))"
    best = f"flatten(transform(array(named_struct('words', split(trim(s), ' '), 'phrases', phrases)), r -> transform(r.phrases, t -> named_struct('template', t, 'coverage', array_max(transform(array_distinct({starts}), start -> {coverage}))))))"
    aligned = F.expr(f"CASE WHEN size(phrases) > 0 THEN filter({best}, x -> x.coverage >= {COVERAGE}D) END")
    rows = rows.withColumn("phrases", _phrases(F.col("s"))).withColumn("aligned", aligned)
    label = lambda x: F.element_at(F.array(*(F.lit(name) for name, _, _ in TEMPLATES)), x["template"] + 1)
    found = F.array_distinct(F.transform("aligned", label))
    return rows.withColumns({"found": F.coalesce(found, F.array().cast("array<string>")), "coverage": F.when(F.size(found) > 0, F.least(F.array_max(F.transform("aligned", lambda x: x["coverage"])), F.lit(1.0)))}).drop("phrases", "aligned")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text, ...).

    score is 1 where a base phrase stands, else the largest share of a confirmed template's
    rarity that is aligned, else 0.  A null or empty text has no words and no labels.  Every
    row is judged by its own text, also where a doc_id repeats or is null.  Other columns are
    ignored; an empty table gives no rows.
    """
    out = template_labels(base_labels(_rows(docs)))
    both = F.array_sort(F.array_union("base", "found"))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.round("coverage", 6), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))
