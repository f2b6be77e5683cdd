"""License scans, in DataFrame functions only.

One pass over the text makes a small row for each document, which is written: base columns, and the template tokens of each
block. Letters A-Z are lower-cased and separators become blanks, but for sentence marks and line ends, by one translate().

Phrases: places where a phrase's words stand consecutively. Each separator run becomes two blanks, so every word owns the
blank on either side and phrase places are plain substrings; word positions are counts of blanks.

Templates: an exact containment join. Blocks are paragraphs (between blank lines) for templates that are paragraphs of
license texts, and sentences (between . ! ? ; within a paragraph) for those that are one sentence; a single line end is white space, since
license texts are wrapped. A block meets a template when it holds at least `threshold` of the template's distinct tokens.
Tokens are ordered by the number of sentences that hold them, over all documents. A block that meets a template of n tokens shares
a = ceil(threshold * n) of them, so it has one of the template's n - a + 1 rarest (prefix filter), has at
least a tokens of templates (length filter), and what follows its first shared token on both sides still
reaches a (positional filter). What passes is verified by intersection.

The template index is a parameter of bounded size and is broadcast; text is never shuffled. Labels go back by the number of a row, not by
its id, so rows with null or equal ids keep their own. Null text is empty and has no labels; texts of any length are
scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences of public licenses and license notices, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
)
#: Whole paragraphs of public licenses, with their labels.
PARAGRAPHS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
)
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = ".!?;"
_BLANK = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in _MARKS + "\n")


def spelled(text: Column) -> Column:
    """Words of lower-case letters, digits and what is beyond ASCII; between them blanks, line ends, and a point for each sentence mark."""
    return F.translate(text, _UPPER + _MARKS + _BLANK, _LOWER + "." * len(_MARKS) + " " * len(_BLANK))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _padded(words: Column) -> Column:
    """The words, each with a blank on either side."""
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def base_columns(phrases: dict[str, str]) -> list[Column]:
    """n_words, n_base, first_word, last_word and found (labels of the phrases) from norm."""
    n_words = (_blanks(F.col("norm")) / 2).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        own = phrase.split()
        written = " " + "  ".join(own) + " "
        there = F.col("norm").contains(written)
        without = F.replace(F.col("norm"), F.lit(written), F.lit(""))
        counts.append(F.when(there, ((F.length("norm") - F.length(without)) / len(written)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, (_blanks(F.substring_index("norm", written, 1)) / 2).cast("long")))
        lasts.append(F.when(there, n_words - (_blanks(F.substring_index("norm", written, -1)) / 2).cast("long") - len(own)))
        labels.append(F.when(there, F.lit(label)))
    pick = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    return [n_words.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), pick(F.least, firsts).alias("first_word"), pick(F.greatest, lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("found")]


def template_tokens(text: Column, vocabulary: list[str]) -> Column:
    """For each paragraph, for each of its sentences, the distinct tokens that templates have, as places in the vocabulary."""
    place = F.create_map(*(F.lit(x) for pair in zip(vocabulary, range(len(vocabulary)), strict=True) for x in pair))
    known = lambda s: F.array_distinct(F.transform(F.filter(F.split(s, "[ \n]+"), lambda w: w.isin(vocabulary)), lambda w: place[w]))
    some = lambda lists: F.filter(lists, lambda x: F.size(x) > 0)
    return some(F.transform(F.split(text, "\n *\n"), lambda p: some(F.transform(F.split(p, "\\.+"), known))))


def token_order(rows: DataFrame, count: int) -> list[int]:
    """Rank of each template token by the number of sentences that hold it, rarest first."""
    each = rows.select(F.explode(F.flatten(F.flatten("blocks"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.token: r.n for r in each.toLocalIterator()}  # one row for each token of the templates
    rank = [0] * count
    for k, token in enumerate(sorted(range(count), key=lambda t: (counts.get(t, 0), t))):
        rank[token] = k
    return rank


def template_join(blocks: DataFrame, rank: list[int], templates: list[tuple[str, list[int]]], threshold: float) -> DataFrame:
    """row, label, containment of every block (row, known: token places) that meets a template."""
    spark = blocks.sparkSession
    index, whole = [], []
    for k, (label, places) in enumerate(templates):
        tokens = sorted(rank[t] for t in places)
        least = math.ceil(threshold * len(tokens) - 1e-9)
        whole.append((k, label, tokens, len(tokens), least))
        index += [(t, k, p) for p, t in enumerate(tokens[: len(tokens) - least + 1])]
    # tokens outside every template come first in the order: they are the rarest for this join
    ranks = F.array(*map(F.lit, rank))
    ranked = blocks.where(F.size("known") >= min(w[4] for w in whole)).select("row", F.array_sort(F.transform("known", lambda t: ranks[t])).alias("known"))
    posted = F.broadcast(spark.createDataFrame(index, "rank int, template int, position int"))
    sides = F.broadcast(spark.createDataFrame(whole, "template int, label string, own array<int>, n int, least int"))
    candidates = (
        ranked.select("*", F.posexplode("known").alias("at", "rank"))
        .join(posted, "rank")
        .join(sides, "template")
        .where((F.size("known") >= F.col("least")) & (F.least(F.size("known") - F.col("at"), F.col("n") - F.col("position")) >= F.col("least")))
    )
    shared = F.size(F.array_intersect("known", "own"))
    return candidates.where(shared >= F.col("least")).select("row", "label", (shared / F.col("n")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, paragraphs=PARAGRAPHS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({t for _, text in (*templates, *paragraphs) for t in text.split()})
    place = {t: k for k, t in enumerate(vocabulary)}
    # explode() of one value keeps each text from being worked out again for every expression that uses it
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.array(spelled(F.coalesce(F.col(text_col), F.lit(""))))).alias("plain"))
    rows = rows.select("doc_id", "plain", F.explode(F.array(_padded(F.trim(F.regexp_replace("plain", "[ .\n]+", "  "))))).alias("norm"))
    rows = cut(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *base_columns(phrases), template_tokens(F.col("plain"), vocabulary).alias("blocks")))
    rank, met = token_order(rows, len(vocabulary)), None
    per_paragraph = rows.select("row", F.explode("blocks").alias("paragraph"))
    for own, blocks in ((templates, per_paragraph.select("row", F.explode("paragraph").alias("known"))), (paragraphs, per_paragraph.select("row", F.array_distinct(F.flatten("paragraph")).alias("known")))):
        if own:
            part = template_join(blocks, rank, [(label, sorted({place[t] for t in text.split()})) for label, text in own], threshold)
            met = part if met is None else met.union(part)
    if met is None:
        found = rows.withColumns({"met": F.array().cast("array<string>"), "best": F.lit(None).cast("double")})
    else:
        found = rows.join(met.groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best")), "row", "left")  # a label of the templates each
    both = F.array_sort(F.array_union("found", F.coalesce("met", F.array().cast("array<string>"))))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
