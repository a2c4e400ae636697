"""License scans: an exact containment join of text blocks with license templates.

A block of a template is any run of as many consecutive words as the template has, and a quarter more (``slack``). It
matches when at least ``threshold`` of the template's distinct words stand in it. Notices of fewer than ``least_words``
distinct words say too little out of order: they match where their words stand one after another. Tokens are ordered
by how many documents hold them, counted over all documents, rarest first. The first token in that order that a
matching block shares with the template is one of the template's first |T| - a + 1 tokens (a = the least overlap). So
only places of such prefix tokens are looked at; the length filter fixes how far around such a place a block can
reach, the positional filter asks for a - 1 of the tokens behind the prefix token's place in the order, and the
remaining pairs are verified in every block around the place. Base labels come from phrases. DataFrame functions only.

A label shows for every template matched, but for matches whose words all belong to a better match (a larger share,
then a larger template) that begins within a block's length of it: the GPL's words inside an AGPL notice are not GPL.
Of one template, the best match (the first on a tie) among those that begin in the same 128 words is compared.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned each; other
columns are ignored; very long texts are scanned whole, cut into overlapping stretches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, for A-Z before lower-casing too, and the phrases with their base labels.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Whole licenses, their standard notices and telling sentences, with the label that each shows. Fixed values.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
            "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                 "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
              "either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
              "either version 3 of the license or at your option any later version"),
    ("lgpl", "free software foundation gnu lesser general public license at your option any later version"),
    ("lgpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
               "either version 3 of the license or at your option any later version"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
               "either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    slack: float = 1.25
    least_words: int = 12
    stride: int = 128


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """All words, lower-cased, in order."""
    return F.filter(F.split(lowered(text), GAP), lambda w: w != "")


def document_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Documents that hold each word of ``vocabulary``, over all documents."""
    known = F.array(*map(F.lit, vocabulary))
    return docs.select(F.explode(F.array_intersect(words(F.coalesce("text", F.lit(""))), known)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def phrase_patterns() -> dict[str, str]:
    """Label -> pattern of its phrase. The look-behind stands after the first letter, so it is tried at that letter only."""
    fold = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    inside = WORD[:-1]
    out = {}
    for phrase, label in PHRASES.items():
        first, rest = f"[{phrase[0]}{phrase[0].upper()}]", GAP.join(map(fold, phrase.split()))
        out[label] = f"{first}(?<!{inside}{first}){rest[len(first):]}(?!{inside})"
    return out


def phrase_columns(docs: DataFrame) -> DataFrame:
    """Places of the base phrases per row of ``docs`` (doc_id, text): h (hash of the text), n_words, n_base, first_word, last_word, base (labels).

    A text is searched once; what follows from the places is worked out only where there are any.
    """
    each = phrase_patterns()
    any_ = "(?:" + "|".join(each.values()) + ")"
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("long")
    seen = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), count(F.col("text"), WORD).alias("n_words"), F.regexp_extract_all("text", F.lit(f"({any_})"), F.lit(1)).alias("found"))
    shows = lambda p: lambda x: x.rlike(p)
    has, pieces = F.size("found") > 0, F.split("text", any_, -1)
    labels = F.filter(F.array(*[F.when(F.exists("found", shows(p)), F.lit(label)) for label, p in each.items()]), lambda x: x.isNotNull())
    return seen.select(
        "doc_id", "h", "n_words", F.size("found").cast("long").alias("n_base"), F.when(has, count(F.element_at(pieces, 1), WORD)).alias("first_word"),
        F.when(has, F.col("n_words") - count(F.element_at(pieces, -1), WORD) - count(F.element_at("found", -1), WORD)).alias("last_word"),
        F.when(has, labels).otherwise(F.array().cast("array<string>")).alias("base"))


def block_matches(docs: DataFrame, settings: Settings = Settings(), templates=TEMPLATES) -> DataFrame:
    """(doc_id, h, template, label, size, overlap, held, at, span): the best match of every template in each stretch that has one.

    ``h`` is a hash of the text, ``at`` the match's first word, ``held`` the template's words in it. Every document is
    scanned on its own and the only joins have the templates, whose number is fixed, on the other side.
    """
    spark, stride = docs.sparkSession, settings.stride
    counts = document_counts(docs, sorted({w for _, text in templates for w in text.split()}))
    # As many rows as the templates have words; read once by the driver to state the order in the plan.
    held_by = {r.token: r.documents for r in counts.collect()}
    index, rows, reach = [], [], 1
    for i, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=lambda t: (held_by.get(t, 0), t))
        whole = len(own) < settings.least_words
        need = len(own) if whole else math.ceil(len(own) * settings.threshold - 1e-9)
        span = len(text.split()) if whole else math.ceil(len(text.split()) * settings.slack - 1e-9)
        rows.append((i, label, len(own), need, span, own, f" {text} " if whole else None))
        index += [(t, place, i) for place, t in enumerate(own[: len(own) - need + 1])]
        reach = max(reach, span)
    prefix = F.array(*map(F.lit, sorted({t for t, _, _ in index})))
    # A document without any prefix token holds no match, and neither does a stretch of one.
    text = F.col("text")
    chosen = docs.where(text.isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), words(text).alias("words")).where(F.arrays_overlap("words", prefix))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride)), lambda s: F.arrays_overlap(F.slice(F.col("words"), s + 1, F.lit(stride)), prefix))
    low = lambda s, span: F.greatest(s - span + 1, F.lit(0))
    around = lambda s: F.slice(F.col("words"), low(s, F.lit(reach)) + 1, s - low(s, F.lit(reach)) + stride + reach - 1)
    stretch = F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_intersect(prefix, F.slice(F.col("words"), s + 1, F.lit(stride))).alias("tokens"), around(s).alias("near")))
    stretches = chosen.select("doc_id", "h", F.explode(stretch).alias("b")).select("doc_id", "h", "b.s", "b.near", F.explode("b.tokens").alias("token"))
    index_df = spark.createDataFrame(index, "token string, place int, template int")
    template_df = spark.createDataFrame(rows, "template int, label string, size int, need int, span int, own array<string>, whole string")
    s, span, own = F.col("s"), F.col("span"), F.col("own")
    first = low(s, span)
    pairs = (stretches.join(F.broadcast(index_df), "token").join(F.broadcast(template_df), "template")
             .withColumn("near", F.slice("near", first - low(s, F.lit(reach)) + 1, s - first + stride + span - 1))
             .where(F.size(F.array_intersect(F.slice(own, F.col("place") + 1, F.col("size")), "near")) >= F.col("need")))
    # A matching block still matches when it begins with its first word of the template.
    block = lambda i: F.slice(F.col("near"), i + 1, span)
    begins = F.filter(F.sequence(F.lit(0), F.size("near") - 1), lambda i: F.array_contains(own, F.get("near", i)))
    spoken = lambda i: F.col("whole").isNull() | F.startswith(F.concat(F.lit(" "), F.array_join(block(i), " "), F.lit(" ")), F.col("whole"))
    scored = F.transform(F.filter(begins, spoken), lambda i: F.struct(F.size(F.array_intersect(own, block(i))).alias("overlap"), (-i).alias("back")))
    best = pairs.select("doc_id", "h", "template", "label", "size", "need", "span", "own", "near", first.alias("first"), F.array_max(scored).alias("best")).where("best.overlap >= need")
    return best.select("doc_id", "h", "template", "label", "size", F.col("best.overlap").alias("overlap"), F.array_intersect("own", F.slice("near", 1 - F.col("best.back"), span)).alias("held"),
                       (F.col("first") - F.col("best.back")).alias("at"), "span")


def shown(matches: DataFrame, stride: int = 128) -> DataFrame:
    """The matches whose words do not all belong to a better match beside them: (doc_id, h, label, share).

    Matches meet by zones of ``stride`` words. A zone holds at most one match per template, so its group is bounded; a
    match is compared with those of its own and of the zones that a block's length reaches.
    """
    zone = F.floor(F.col("at") / stride).cast("int")
    share = (F.col("overlap") / F.col("size")).alias("share")
    places = matches.withColumn("zone", zone).groupBy("doc_id", "h", "zone", "template").agg(
        F.max(F.struct(share, "size", (-F.col("at")).alias("back"), "label", "held", "span")).alias("m"))
    reach = F.ceil(F.col("m.span") / stride).cast("int")
    near = places.select("doc_id", "h", F.col("zone").alias("home"), "template", "m", F.explode(F.sequence(F.col("zone") - reach, F.col("zone") + reach)).alias("zone"))
    groups = near.groupBy("doc_id", "h", "zone").agg(F.collect_list(F.struct("home", "template", "m")).alias("all"))
    rank = lambda x: F.struct(x["m"]["share"], x["m"]["size"], x["template"])
    beside = lambda x, y: F.abs(x["m"]["back"] - y["m"]["back"]) < F.greatest(x["m"]["span"], y["m"]["span"])
    inside = lambda x, y: (rank(y) > rank(x)) & beside(x, y) & (F.size(F.array_except(x["m"]["held"], y["m"]["held"])) == 0)
    kept = F.filter("all", lambda x: (x["home"] == F.col("zone")) & ~F.exists("all", lambda y: inside(x, y)))
    return groups.select("doc_id", "h", F.explode(kept).alias("x")).select("doc_id", "h", "x.m.label", "x.m.share")


def licenses(docs: DataFrame, settings: Settings = Settings(), templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template that a block holds, and 1 where a base phrase stands.
    """
    matches = shown(block_matches(docs, settings, templates), settings.stride)
    found = matches.groupBy(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h")).agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    rows = phrase_columns(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.found_id) & (rows.h == found.found_h), "left")
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.col("base"), F.coalesce("more", empty)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                         F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
