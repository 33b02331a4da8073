"""License scans: fixed phrases, and an exact set-similarity join with license templates.

Base: the places where a phrase's words stand consecutively in a text.

Templates: a text block carries a template when it holds at least the threshold
share of the template's distinct words. Blocks are windows of 2 * size words at
every size-th word of the whole text, line ends ignored, for each of SIZES;
a template belongs to the smallest size that its words fit, so wherever it
stands it lies whole in some block.

Template words are ordered by how often they occur in all documents, rarest
first; of a block, only these words matter, in the same order. If r words of a
template are required, and m is the smallest r of its size:

- prefix: a template's first len - r + 1 words are indexed, and of a block the
  first len - m + 1 are looked up, for sets that share r words share one there;
- length: the block must hold r template words;
- position: if their first common word is the template's p-th and the block's
  q-th, 1 + min(len - p, len - q) words can be common at most, after them.

Pairs that pass are verified by the exact intersection. Texts without any
indexed word make no blocks. Everything is DataFrame operations, in one scan
after the one that counts words. The templates are fixed text, so what is
joined as a broadcast has a size that does not depend on the data.

Defined results: a null or empty text has no words, labels '' and score 0;
rows with equal ids, also of different texts, and repeated rows each get a row
of their own; an empty table gives an empty result; other columns are ignored;
very long texts are scanned whole, and their blocks are rows of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandscan.llm.common import WORD_ALNUM, ascii_lower

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template passages by label: statements that licenses ask to be put in front of works, and their grants.
TEMPLATES = {
    "template:apache-2.0": "licensed under the apache license version 2 0",
    "template:apache-2.0-notice": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "template:bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "template:bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "template:cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "template:cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "template:cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "template:gpl-3": "this work is licensed under the gnu general public license version 3",
    "template:gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "template:isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "template:mit": "released under the mit license",
    "template:mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "template:mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "template:unlicense": "this is free and unencumbered software released into the public domain",
    "template:zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
THRESHOLD = 0.9
#: Words that a template of each size has at most.
SIZES = (12, 24, 60)


def need(tokens: int, threshold: float) -> int:
    """The words required of a template of so many."""
    return max(1, math.ceil(threshold * tokens - 1e-9))


def size_of(template: str, sizes: tuple = SIZES) -> int:
    """The smallest size that a template fits."""
    return next(s for s in sizes if len(template.split()) <= s)


def template_order(docs: DataFrame, text_col: str, templates: dict[str, str]) -> list[str]:
    """The templates' words, those rarest in all documents first; as many rows are collected as the templates have words."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    said = docs.select(F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD_ALNUM), F.lit(0))).alias("w"))
    counts = {r["w"]: r["count"] for r in said.where(F.col("w").isin(vocabulary)).groupBy("w").count().limit(len(vocabulary)).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _strings(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _index(templates: dict[str, str], order: list[str], threshold: float, sizes: tuple) -> tuple[str, dict[int, int], list[str]]:
    """SQL for the indexed words as an array of structs, the smallest need of each size, and the words themselves."""
    rank, rows, least, words = {w: k for k, w in enumerate(order)}, [], {}, set()
    for label, text in templates.items():
        tokens = sorted(set(text.split()), key=rank.get)
        r, size = need(len(tokens), threshold), size_of(text, sizes)
        least[size] = min(r, least.get(size, r))
        for p, w in enumerate(tokens[: len(tokens) - r + 1]):
            rows.append(f"named_struct('w', '{w}', 'size', {size}, 'p', {p}, 'label', '{label}', 'tokens', {_strings(tokens)}, 'need', {r})")
            words.add(w)
    return f"array({', '.join(rows)})", least, sorted(words)


def blocks(w: str, order: list[str], least: dict[int, int], words: list[str]) -> str:
    """SQL: the blocks of a text's words w as structs (size, b): their template words, rarest first; only such with enough of them."""
    some = [
        f"filter(transform(sequence(0, size({w}) - 1, {size}), i -> named_struct('size', {size}, 'b', array_intersect({_strings(order)}, slice({w}, i + 1, {2 * size})))), x -> size(x.b) >= {m} AND arrays_overlap(x.b, {_strings(words)}))"
        for size, m in sorted(least.items())
    ]
    return f"concat({', '.join(some)})"


def tried_pairs(rows: DataFrame, templates: dict[str, str], order: list[str], threshold: float = THRESHOLD, sizes: tuple = SIZES) -> DataFrame:
    """rows (..., block) with the templates that share a word of both prefixes: adds q, p, label, tokens, need; null where none does."""
    index, least, _ = _index(templates, order, threshold, sizes)
    by_size = "CASE block.size " + " ".join(f"WHEN {k} THEN {m}" for k, m in least.items()) + " END"
    looked = rows.select("*", F.expr(f"posexplode_outer(slice(block.b, 1, size(block.b) - {by_size} + 1))").alias("q", "w"))
    known = rows.sparkSession.range(1).select(F.inline(F.expr(index))).withColumnsRenamed({"w": "iw", "size": "isize"})
    return looked.join(F.broadcast(known), F.expr("w = iw AND block.size = isize"), "left").drop("iw", "isize", "w")


#: SQL: may a tried pair still have the words required, by length and by position?
LONG_ENOUGH = "size(block.b) >= need"
WELL_PLACED = "1 + least(size(tokens) - p - 1, size(block.b) - q - 1) >= need"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, sizes: tuple = SIZES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each document.

    score is the best containment of a template found, 1 with a base phrase.
    """
    order = template_order(docs, text_col, templates)
    _, least, words = _index(templates, order, threshold, sizes)
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD_ALNUM), F.lit(0)).alias("w"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    places = [f"filter(sequence(0, size(w) - 1), i -> {' AND '.join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(p.split()))})" for p in phrases]
    has = f"arrays_overlap(w, {_strings(sorted({p.split()[-1] for p in phrases}))})"
    names = ", ".join(f"'{x}'" for x in phrases.values())
    none = "cast(array() AS array<string>)"
    found = rows.select(
        "row", "id", F.size("w").cast("long").alias("n_words"), F.expr(f"if({has}, array({', '.join(places)}), NULL)").alias("at"),
        F.expr(f"if(arrays_overlap(w, {_strings(words)}), {blocks('w', order, least, words)}, NULL)").alias("blocks"),
    ).select(
        "row", "id", "n_words", F.flatten("at").alias("all"), "blocks",
        F.expr(f"if(at IS NULL, {none}, array_sort(array_distinct(filter(transform(array({names}), (x, k) -> if(size(at[k]) > 0, x, NULL)), x -> x IS NOT NULL))))").alias("base"),
    ).select(
        "row", "id", "n_words", "base", F.expr("if(all IS NULL, 0, size(all))").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"), F.explode_outer("blocks").alias("block"),
    )
    tried = tried_pairs(found, templates, order, threshold, sizes)
    common = F.expr(f"if({LONG_ENOUGH} AND {WELL_PLACED}, size(array_intersect(block.b, tokens)), 0)")
    carried = tried.select("row", "id", "n_words", "base", "n_base", "first_word", "last_word", "label", "need", common.alias("common"), F.size("tokens").alias("n"))
    good = F.col("common") >= F.col("need")
    facts = ["n_words", "n_base", "first_word", "last_word", "base"]
    out = carried.groupBy("row", "id").agg(*[F.first(c).alias(c) for c in facts], F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max(F.when(good, F.col("common") / F.col("n"))).alias("best"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "more"))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).cast("double").alias("score"),
    )
