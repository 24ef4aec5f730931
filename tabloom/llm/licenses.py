"""License scans: named licenses by phrase, and license notices by an exact set-similarity join.

All work is done by built-in functions. Words of a text are compared in lower case.

Base: the places where the words of a phrase stand one after the other.

The method: texts are cut into blocks, windows of words that overlap by half, and each
block whose words contain a share of at least ``CONTAINMENT`` of the different words
(tokens) of a license notice gets that notice's label. A first pass counts in how many
texts each token of a notice stands; rare tokens come first in every token list. Then

* prefix filter: a notice of m tokens of which a must be found shares with such a block
  one of its first m - a + 1 tokens, so texts without any of these are not cut up at all,
  and blocks are matched by an equality join on single prefix tokens;
* length filter: a block has at least a tokens of notices;
* positional filter: at the first shared token, the shorter rest of both lists must still
  allow a shared tokens. A pair that shares an earlier one has been met there.

What passes is verified by intersecting the token lists. Notices are few and given by the
caller; their tokens and prefixes are small literals and a small broadcast table, whatever
the size of the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licenses, label by label.
NOTICES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
)

# Share of a notice's tokens that a block must contain.
CONTAINMENT = 0.9

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words, of which those without marks beyond ASCII are in lower case.

    Lower case by Unicode differs from that of A to Z in letters beyond ASCII, which no token
    holds; only the Kelvin sign would become a plain letter, so another one takes its place.
    """
    plain = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1))


def _tokens(notice: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", notice.lower())))


def _least(tokens: list[str], containment: float) -> int:
    """Tokens of a notice that a block must contain."""
    return math.ceil(round(containment * len(tokens), 9))


def _window(notice: str) -> int:
    """Words of a block for a notice: a power of two, so that a block overlapping by half holds any place of the notice."""
    return 1 << max(4, math.ceil(math.log2(2 * len(re.findall(r"[a-z0-9]+", notice.lower())))))


def _list(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_frequencies(docs: DataFrame, text_col: str, tokens: list[str]) -> dict[str, int]:
    """In how many of all texts each token stands; as many rows come to the driver as there are tokens."""
    words = docs.select(_words(F.col(f"`{text_col}`")).alias("words"))
    found = words.select(F.explode(F.array_intersect(_list(tokens), "words")).alias("token")).groupBy("token").count()
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in found.collect()}


def _places(words: Column, phrases: Mapping[str, str]) -> Column:
    """``array<struct<at, label>>``: where the words of a phrase stand one after the other."""
    parts = [(p.split(), label) for p, label in phrases.items()]
    firsts = sorted({p[0] for p, _ in parts})

    def here(at: Column) -> Column:
        hits = [
            F.when(
                reduce(lambda a, b: a & b, [F.get(words, at + k) == F.lit(w) for k, w in enumerate(p)]),
                F.struct(at.cast("bigint").alias("at"), F.lit(label).alias("label")),
            )
            for p, label in parts
        ]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*firsts), i)), lambda i: i.isNotNull())
    none = F.expr("CAST(array() AS array<struct<at: bigint, label: string>>)")
    return F.when(F.arrays_overlap(words, _list(firsts)), F.flatten(F.transform(starts, here))).otherwise(none)


def _blocks(words: Column, window: int, tokens: list[str], prefixes: list[str], least: int) -> Column:
    """``array<struct<window, tokens>>``: blocks that pass the prefix and length filters, their tokens rare ones first."""
    half = window // 2
    last = F.greatest(F.ceil((F.size(words) - window) / F.lit(half)), F.lit(0)) * half
    starts = F.sequence(F.lit(0), last.cast("int"), F.lit(half))
    cut = F.transform(starts, lambda at: F.slice(words, at + 1, F.lit(window)))
    cut = F.filter(cut, lambda block: F.arrays_overlap(block, _list(prefixes)))
    cut = F.transform(cut, lambda block: F.struct(F.lit(window).alias("window"), F.array_intersect(_list(tokens), block).alias("tokens")))
    return F.filter(cut, lambda block: F.size(block["tokens"]) >= least)


def license_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices)`` of every row of ``docs``.

    ``score`` is 1 where a phrase stands, else the largest share of a notice that a block
    contains, 0 if it is below ``containment``; ``notices`` counts the different notices
    found. Null and empty texts have no words and no labels. Repeated rows and null ids stay
    as they are, an empty table gives no rows, and other columns are not looked at.
    """
    lists = [(label, _window(notice), _tokens(notice)) for label, notice in notices]
    vocabulary = sorted({t for _, _, own in lists for t in own})
    spread = token_frequencies(docs, text_col, vocabulary) if vocabulary else {}
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (spread[t], t)))}

    # A row per prefix token of each notice.
    index, classes = [], {}
    for number, (label, window, own) in enumerate(lists):
        own = sorted(own, key=order.get)
        least = _least(own, containment)
        prefix = own[: len(own) - least + 1]
        index += [(window, t, at, number, label, least, own) for at, t in enumerate(prefix)]
        held = classes.setdefault(window, (set(), set(), []))
        held[0].update(own)
        held[1].update(prefix)
        held[2].append(least)

    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        _words(F.col(f"`{text_col}`")).alias("words"),
    )
    words = F.col("words")
    blocks = [_blocks(words, w, sorted(all_, key=order.get), sorted(pre, key=order.get), min(least)) for w, (all_, pre, least) in sorted(classes.items())]
    nothing = F.expr("CAST(array() AS array<struct<window: int, tokens: array<string>>>)")
    if blocks:
        marks = sorted({t for _, pre, _ in classes.values() for t in pre}, key=order.get)
        nothing = F.when(F.arrays_overlap(words, _list(marks)), F.concat(*blocks)).otherwise(nothing)
    places = F.col("places")
    marked = rows.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), _places(words, phrases).alias("places"), nothing.alias("blocks"))
    marked = marked.select(
        "doc_id",
        "row",
        "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["at"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))).alias("base"),
        "blocks",
    )
    # The texts are read for the last time here; what follows works on blocks that may hold a notice.
    marked = Scratch(docs.sparkSession).write(marked, "license-blocks")
    own = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    plain = marked.where(F.size("blocks") == 0).select(*own, F.lit(0.0).alias("share"), F.expr("CAST(array() AS array<string>)").alias("more"), F.lit(0).cast("bigint").alias("notices"))
    done = plain.unionByName(_joined(marked.where(F.size("blocks") > 0), index, own)) if index else plain
    return done.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("share")).alias("score"),
        "notices",
    )


def _joined(marked: DataFrame, index: list[tuple], own: list[str]) -> DataFrame:
    """The rows of ``marked`` with the labels of the notices that their blocks contain."""
    names = ["window", "token", "at", "number", "label", "least", "list"]
    entries = [F.struct(*[(_list(v) if isinstance(v, list) else F.lit(v)).alias(f"t_{n}") for n, v in zip(names, entry)]) for entry in index]
    notices = marked.sparkSession.range(1).select(F.inline(F.array(*entries)))
    blocks = marked.select("row", *own, F.explode("blocks").alias("block"))
    blocks = blocks.select("row", *own, F.col("block.window").alias("b_window"), F.col("block.tokens").alias("b_list"))
    # No notice needs fewer tokens than the least of all, so later tokens of a block open no pair.
    fewest = min(entry[5] for entry in index)
    heads = blocks.withColumn("head", F.expr(f"slice(b_list, 1, size(b_list) - {fewest} + 1)"))
    heads = heads.select("row", *own, "b_window", "b_list", F.posexplode("head").alias("b_at", "b_token"))
    met = heads.join(F.broadcast(notices), (F.col("b_window") == F.col("t_window")) & (F.col("b_token") == F.col("t_token")), "left")
    overlap = F.size(F.array_intersect("b_list", "t_list"))
    rest = 1 + F.least(F.size("b_list") - F.col("b_at") - 1, F.size("t_list") - F.col("t_at") - 1)
    first = ~F.arrays_overlap(F.expr("slice(b_list, 1, b_at)"), F.expr("slice(t_list, 1, t_at)"))
    good = (F.size("b_list") >= F.col("t_least")) & (rest >= F.col("t_least")) & first & (overlap >= F.col("t_least"))
    share = F.when(good, overlap / F.size("t_list"))
    return met.groupBy("row").agg(
        *[F.first(c).alias(c) for c in own],
        F.coalesce(F.max(share), F.lit(0.0)).alias("share"),
        F.collect_set(F.when(good, F.col("t_label"))).alias("more"),
        F.count_distinct(F.when(good, F.col("t_number"))).alias("notices"),
    ).drop("row")
