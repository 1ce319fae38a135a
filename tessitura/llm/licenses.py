"""License detection: phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of words of a license's notice. A text block is a stretch of words that begins at the place of any of the template's words and is as
wide as the template allows (``width`` words), so a notice is found wherever it begins and with words between its lines. A block matches
if it holds at least ``threshold`` of the template's distinct words.

Tokens are ordered by their frequency over the whole corpus, rarest first. A matching block holds one of the ``|T| - need + 1`` rarest tokens of its
template (prefix filter), so the table of prefix tokens is joined with the places of those tokens in the texts. Texts are measured off in cells as wide as
a block: the blocks that begin in a cell end in the next one at the latest, so a prefix token's place asks for its own cell and the one before, and only the
template's words in cells asked for are gathered, at most two block widths of them whatever the text's length. There must be ``need`` distinct template words in the
two cells at all (length filter), and around some prefix place of rank ``i`` as many of rank ``i`` and beyond (positional filter). What is left is counted exactly, for every block. A document that
doesn't hold enough of any template's words as a whole ends after one scan.

Places are rows of a few numbers, so the work is linear in the template words of a text. The templates are a fixed list: the tables that are broadcast have a few hundred rows and never grow with the data.

Defined results: null and empty texts have no words, no places and no labels, score 0; rows are independent, so
repeated rows, ties and null keys need no rule; further columns are ignored. ``score`` is the best containment found, 1 where a base phrase stands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.benchmark import words
from tessitura.llm.scratch import written

# The base phrases.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences of public licenses and their notices, and two whole license texts, as words; a label may have several.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program if not see"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
)
LEAST_WIDTH, STRETCH, THRESHOLD = 32, 2, 0.8


def least_shared(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def table(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int]]:
    """Of each template its label, distinct words, how many of them a block must hold, and a block's width in words."""
    out = []
    for label, text in templates:
        said = text.split(" ")
        own = list(dict.fromkeys(said))
        out.append((label, own, least_shared(len(own), threshold), max(LEAST_WIDTH, STRETCH * len(said))))
    return out


def phrase_places(w: Column, phrase: str) -> Column:
    """Word indices at which the phrase's words stand consecutively."""
    said = phrase.split(" ")

    def here(i):
        ok = F.get(w, i) == said[0]
        for j, s in enumerate(said[1:], 1):
            ok = ok & F.coalesce(F.get(w, i + j) == s, F.lit(False))
        return ok

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def marked(docs: DataFrame, key: str, text: str, known: list) -> DataFrame:
    """_row, _key, n_words, own (template words that a text holds), at and base (places and labels of phrases), fit: the templates of which the text holds
    enough distinct words, marks: places of template words in texts with such a template, in order."""
    vocabulary = sorted({t for _, own, _, _ in known for t in own})
    every = F.array(*[F.lit(t) for t in vocabulary])
    rows = docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("w")).withColumn("own", F.array_intersect(every, "w"))
    fit = [F.when(F.size(F.array_intersect("own", F.array(*[F.lit(t) for t in own]))) >= need, F.lit(at)) for at, (_, own, need, _) in enumerate(known)]
    rows = rows.withColumn("fit", F.array_compact(F.array(*fit)))
    marks = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("token"))), lambda m: m["token"].isin(vocabulary))
    marks = F.when(F.size("fit") > 0, marks).otherwise(F.array().cast("array<struct<at:int,token:string>>"))
    return rows.select("_key", F.size("w").alias("n_words"), "own", "fit", *_base(F.col("w")), marks.alias("marks")).withColumn("_row", F.monotonically_increasing_id())


def ranked_tokens(spark, known: list, order: dict) -> DataFrame:
    """(token, template, rank, size, need, width): every token of each template, rarest first; those of rank size - need at most are its prefix."""
    rows = []
    for at, (_, own, need, width) in enumerate(known):
        rows += [(t, at, i, len(own), need, width) for i, t in enumerate(sorted(own, key=lambda t: order.get(t, (0, t))))]
    return spark.createDataFrame(rows, "token string, template int, rank int, size int, need int, width int")


def matching_blocks(held: DataFrame, tokens: DataFrame) -> DataFrame:
    """(_row, template, n, share): how many blocks that begin in one cell hold enough of the template, and the largest share. ``held``: _row, fit, marks (a written table)."""
    spots = held.where(F.size("marks") > 0).select("_row", "fit", F.explode("marks").alias("m")).select("_row", "fit", "m.at", "m.token")
    spots = spots.join(F.broadcast(tokens), "token").where(F.array_contains("fit", F.col("template")))  # a few hundred rows, whatever the corpus
    cell = F.expr("at div width").cast("int")
    both = F.explode(F.array(cell, cell - 1)).alias("cell")
    asked = spots.where(F.col("rank") <= F.col("size") - F.col("need")).select("_row", "template", both).where("cell >= 0").distinct()
    spots = spots.select("_row", "template", "at", "rank", "size", "need", "width", both).where("cell >= 0")
    near = spots.join(asked, ["_row", "template", "cell"], "left_semi").groupBy("_row", "template", "cell").agg(
        F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("near"), *[F.first(c).alias(c) for c in ("size", "need", "width")]  # two widths of words at most
    )
    distinct = lambda ms: F.size(F.array_distinct(F.transform(ms, lambda m: m["rank"])))
    prefix = F.filter("near", lambda m: m["rank"] <= F.col("size") - F.col("need"))
    around = lambda p: F.filter("near", lambda m: (F.abs(m["at"] - p["at"]) < F.col("width")) & (m["rank"] >= p["rank"]))
    near = near.where(distinct(F.col("near")) >= F.col("need")).where(F.exists(prefix, lambda p: distinct(around(p)) >= F.col("need")))
    begins = F.filter("near", lambda m: m["at"] < (F.col("cell") + 1) * F.col("width"))
    inside = F.transform(begins, lambda s: distinct(F.filter("near", lambda m: (m["at"] >= s["at"]) & (m["at"] < s["at"] + F.col("width")))))
    full = near.select("_row", "template", "size", F.filter(inside, lambda n: n >= F.col("need")).alias("full")).where(F.size("full") > 0)
    return full.select("_row", "template", F.size("full").alias("n"), (F.array_max("full") / F.col("size")).alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and n_blocks (matching blocks of all templates)."""
    known, spark = table(templates, threshold), docs.sparkSession
    held = written(marked(docs, key, text, known), "license_words")
    counted = held.select(F.explode("own").alias("t")).groupBy("t").count().collect()  # one row for each word of the templates
    tokens = ranked_tokens(spark, known, {r["t"]: (r["count"], r["t"]) for r in counted})
    blocks = matching_blocks(held.select("_row", "fit", "marks"), tokens)
    labels = F.array(*[F.lit(label) for label, _, _, _ in known])
    found = blocks.groupBy("_row").agg(F.collect_set(F.get(labels, F.col("template"))).alias("found"), F.max("share").alias("share"), F.sum("n").alias("n_blocks"))
    rows = held.select("_row", "_key", "n_words", "at", "base").join(found, "_row", "left")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none))))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        F.col("_key").alias(key), F.col("n_words").cast("long").alias("n_words"), F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def _base(w: Column) -> list[Column]:
    """``at``: all places of all phrases; ``base``: their labels, distinct and sorted."""
    said = {p: F.when(F.array_contains(w, p.split(" ")[1]) & F.array_contains(w, p.split(" ")[-1]), phrase_places(w, p)).otherwise(F.array().cast("array<int>")) for p in PHRASES}
    label = [F.when(F.size(a) > 0, F.lit(PHRASES[p])) for p, a in said.items()]
    return [F.concat(*said.values()).alias("at"), F.array_sort(F.filter(F.array(*label), lambda x: x.isNotNull())).alias("base")]
