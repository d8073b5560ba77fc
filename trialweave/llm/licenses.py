"""License scans by a positional index of rare words, in DataFrame functions only.

A template is a license text or a part of one; its mandatory key phrases stand in brackets. The index
holds, for each template, the places of those of its words that the fewest documents contain. Each
document's words are looked up in it, the places a word has in the document are moved back by the place
it has in the template, and a phrase is sought only where its rarest words agree on a start. There the
whole phrase is compared. A template is found if all its phrases are, at alignments that lie in the
same or in neighbouring blocks of ``BLOCK`` words, so that names and years may be put in between.

Counting how many documents hold each word of the templates is one aggregate with a row for each word
and task; everything else is one narrow pass. A frequent word or a hot source has no group to be hot in.
"""
from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

# The word pattern and the phrases with their labels, as the contract has them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (
    ("gpl", "[gnu general public license]"),
    ("apache", "[apache license]"),
    ("cc-by", "[cc by]"),
    ("mit", "[mit license]"),
)
#: Templates of this operator, from public license texts.
MORE = (
    ("agpl", "[gnu affero general public license]"),
    ("all-rights-reserved", "[all rights reserved]"),
    ("apache-notice", "[licensed under the apache license version 2 0] the license you may not use this "
                      "file except [in compliance with the license]"),
    ("boost", "[boost software license]"),
    ("bsd-text", "[redistribution and use in source and binary forms] with or without modification "
                 "[are permitted provided that the following conditions are met]"),
    ("cc-by-nc", "[cc by nc]"),
    ("cc-by-nd", "[cc by nd]"),
    ("cc-by-sa", "[cc by sa]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("epl", "[eclipse public license]"),
    ("gpl-notice", "[this program is free software] you can redistribute it and or modify it [under the "
                   "terms of the gnu general public license]"),
    ("isc-text", "[permission to use copy modify and or distribute this software for any purpose] with "
                 "or without fee [is hereby granted]"),
    ("lgpl", "[gnu lesser general public license]"),
    ("mit-text", "[permission is hereby granted free of charge to any person obtaining a copy] of this "
                 "software and associated documentation files the software [to deal in the software "
                 "without restriction]"),
    ("mpl", "[mozilla public license]"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
)
#: Words of a template that vote for its share, the rarest first.
RARE = 6
#: Words of a phrase whose places are intersected before the phrase is compared.
MEET = 2
#: Alignments in the same or in neighbouring blocks of so many words belong together.
BLOCK_BITS = 5
BLOCK = 1 << BLOCK_BITS
#: Bits for a place in a text, and what is added to it so that no place in a template makes it negative.
PLACE_BITS, BIAS = 33, 1 << 15


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]  # start and end of each, in words


def read_template(label: str, text: str) -> Template:
    """A template with its words and the spans of its bracketed phrases; one phrase at least."""
    words, phrases, start = [], [], 0
    for token in re.findall(rf"[\[\]]|{WORD}", text.translate(str.maketrans(UPPER, LOWER))):
        if token == "[":
            start = len(words)
        elif token == "]":
            phrases.append((start, len(words)))
        else:
            words.append(token)
    if not phrases or any(a >= b for a, b in phrases):
        raise ValueError(f"template {label!r} needs a phrase in brackets")
    if not all(map(str.isascii, words)):
        raise ValueError(f"template {label!r} has letters beyond ASCII")
    return Template(label, tuple(words), tuple(phrases))


def _split(text: Column) -> Column:
    """The words of a whole text, lower-cased; where the text begins or ends with no word character, or
    has none, an empty string stands there too. Extracting every match would take time with the square
    of the text's length. Of the letters beyond A-Z only the Kelvin sign has a lower case in a-z, and
    no word of a template has a letter beyond them, so that lower() does what lower-casing A-Z does."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.split(low, WORD.replace("[^", "["))


def words_of(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row ``doc_id`` and ``words``: none for null."""
    first, last = (F.element_at("words", n) == "" for n in (1, -1))
    size = F.size("words") - first.cast("int") - last.cast("int")
    return (df.select(F.col(doc_id).alias("doc_id"), _split(F.col(text)).alias("words"))
            .select("doc_id", F.slice("words", 1 + first.cast("int"), F.greatest(size, F.lit(0))).alias("words")))


def word_weights(df: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """By word: 1000 times the logarithm of its rarity over all rows, rounded down. The rows that reach
    the driver are one for each word of the templates. An empty table makes all words equally rare."""
    held = F.array_distinct(F.filter(_split(F.col(text)), lambda w: w.isin(sorted(vocabulary))))
    # the empty string is no word; it counts the rows
    counts = dict(df.select(F.explode(F.array_append(held, "")).alias("word")).groupBy("word")
                  .agg(F.count("*")).collect())
    rows = counts.get("", 0)
    return {w: math.floor(1000 * math.log((2 * rows + 2) / (2 * counts.get(w, 0) + 1)))
            for w in vocabulary}


def _rarest(words: list[tuple[str, int]], weights: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The ``most`` rarest different words with their first place; equally rare ones by spelling."""
    first: dict[str, int] = {}
    for word, place in words:
        first.setdefault(word, place)
    return sorted(first.items(), key=lambda x: (-weights[x[0]], x[0]))[:most]


def _table(values: dict[str, list[int]]) -> Column:
    """A literal look-up from word to numbers; its size is that of the templates."""
    return F.create_map(*(x for word, numbers in sorted(values.items()) for x in (
        F.lit(word), F.array(*(F.lit(n).cast("long") for n in numbers)))))


def _looked_up(postings: Column) -> Column:
    """For every hit and posting of its word: the posting's number plus the hit's place."""
    return F.flatten(F.transform("hits", lambda h: F.transform(
        F.coalesce(F.try_element_at(postings, h["word"]), F.slice(F.array(F.lit(0).cast("long")), 1, 0)),
        lambda n: n + h["place"])))


def _blocks(alignments: Column) -> Column:
    """The block of each alignment and the next one, so that neighbours have one in common."""
    return F.array_distinct(F.flatten(F.transform(alignments, lambda a: F.array(
        F.shiftright(a, BLOCK_BITS), F.shiftright(a, BLOCK_BITS) + 1))))


def _without(blocks: Column, how_many: Column, shift: int, p: int) -> Column:
    """The blocks of templates that have no phrase number ``p``."""
    return F.filter(blocks, lambda g: F.get(how_many, F.shiftright(g, shift).cast("int")) <= p)


def find_licenses(df: DataFrame, templates: list[Template], doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``places`` (label, ``start`` in words from 0 and ``length`` of
    every key phrase of every template found, in the order of the templates and then of the text),
    ``labels`` (different ones, sorted) and ``score``: of the templates found the greatest share that
    aligned rare words have in the weight of all its rare words; 0 without a label.

    Null and empty texts have no words and no labels; texts of any length are read whole; repeated rows
    stay repeated; an empty table gives no rows; no column but the two named is read, whatever its name.

    Places are numbers: what the place belongs to (a phrase, a template, a rare word of one) above
    ``PLACE_BITS``, and the place below; sets of them meet by hash, whatever the length of a text.
    """
    if any(len(t.words) >= BIAS for t in templates):
        raise ValueError(f"a template has at most {BIAS - 1} words")
    weights = word_weights(df, {w for t in templates for w in t.words}, text)
    rare = [_rarest([(w, i) for i, w in enumerate(t.words)], weights, RARE) for t in templates]
    phrases = [(k, p, a, b) for k, t in enumerate(templates) for p, (a, b) in enumerate(t.phrases)]
    meet: list[dict[str, list[int]]] = [{} for _ in range(MEET)]
    votes: dict[str, list[int]] = {}
    for number, (k, _, a, b) in enumerate(phrases):
        found = _rarest([(templates[k].words[i], i - a) for i in range(a, b)], weights, MEET)
        for turn in range(MEET):  # a phrase of one word meets itself
            word, place = found[min(turn, len(found) - 1)]
            meet[turn].setdefault(word, []).append((number << PLACE_BITS) + BIAS - place)
    for k, found in enumerate(rare):
        for j, (word, place) in enumerate(found):
            votes.setdefault(word, []).append(((k * RARE + j) << PLACE_BITS) + BIAS - place)
    indexed = sorted({*votes, *(w for table in meet for w in table)})

    def of(values: list, kind: str = "long") -> Column:
        return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")

    owner, number_in, offset = (of([x[i] for x in phrases]) for i in range(3))
    whole = F.array(*(of(list(templates[k].words[a:b]), "string") for k, _, a, b in phrases))
    label, how_many = of([t.label for t in templates], "string"), of([len(t.phrases) for t in templates])
    share = of([weights[w] for found in rare for w, _ in (found + [found[0]] * RARE)[:RARE]])
    total = of([float(sum(weights[w] for w, _ in found)) for found in rare], "double")

    def at(values: Column, n: Column) -> Column:
        return F.get(values, n.cast("int"))

    def above(n: Column) -> Column:
        return F.shiftright(n, PLACE_BITS)

    def below(n: Column) -> Column:
        return n.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - BIAS

    def stands(n: Column) -> Column:
        here, words = below(n), at(whole, above(n))
        return (here >= 0) & (F.slice("words", F.greatest(here + 1, F.lit(1)).cast("int"), F.size(words)) == words)

    rows = words_of(df, doc_id, text).select("doc_id", "words", F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(indexed), F.struct(
            w.alias("word"), i.alias("place")))), lambda h: h.isNotNull()).alias("hits"))
    starts = _looked_up(_table(meet[0]))
    for table in meet[1:]:
        starts = F.array_intersect(starts, _looked_up(_table(table)))
    rows = rows.select("doc_id", "words", "hits", F.array_sort(F.filter(starts, stands)).alias("starts"))

    def aligned(p: int) -> Column:
        return _blocks(F.transform(
            F.filter("starts", lambda n: at(number_in, above(n)) == p),
            lambda n: F.shiftleft(at(owner, above(n)), PLACE_BITS) + BIAS + below(n) - at(offset, above(n))))

    shift = PLACE_BITS - BLOCK_BITS
    agreed = aligned(0)
    for p in range(1, max(len(t.phrases) for t in templates)):
        agreed = F.concat(F.array_intersect(agreed, aligned(p)), _without(agreed, how_many, shift, p))
    rows = rows.select("doc_id", "words", "hits", "starts", agreed.alias("agreed"))
    found = F.array_distinct(F.transform("agreed", lambda g: F.shiftright(g, shift)))
    wanted = F.flatten(F.transform("agreed", lambda g: F.transform(
        F.sequence(F.lit(0), F.lit(RARE - 1)),
        lambda j: F.shiftleft(F.shiftright(g, shift) * RARE + j, shift)
        + g.bitwiseAND(F.lit((1 << shift) - 1)))))
    held = F.array_distinct(F.transform(
        F.array_intersect(_blocks(_looked_up(_table(votes))), wanted), lambda n: F.shiftright(n, shift)))
    rows = rows.select("doc_id", "words", "starts", found.alias("found"), held.alias("held"))

    def held_share(k: Column) -> Column:
        own = F.filter("held", lambda n: F.floor(n / RARE) == k)
        weight = F.aggregate(own, F.lit(0).cast("long"), lambda x, n: x + at(share, n))
        return F.when(at(total, k) > 0, weight / at(total, k)).otherwise(F.lit(1.0))

    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.transform(F.filter("starts", lambda n: F.array_contains("found", at(owner, above(n)))),
                    lambda n: F.struct(at(label, at(owner, above(n))).alias("label"), below(n).alias("start"),
                                       F.size(at(whole, above(n))).alias("length"))).alias("places"),
        F.array_sort(F.array_distinct(F.transform("found", lambda k: at(label, k)))).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", held_share)), F.lit(0.0)).alias("score"))


def digest(found: DataFrame, base: set[str]) -> DataFrame:
    """The counts and joined labels of ``find_licenses``: ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels`` from the places whose label is in ``base``."""
    own, = fresh(found, "own")
    at = F.transform(own, lambda p: p["start"])
    return (found.withColumn(own, F.filter("places", lambda p: p["label"].isin(sorted(base))))
            .select("doc_id", "n_words", F.size(own).cast("long").alias("n_base"),
                    F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                    F.array_join(F.array_sort(F.array_distinct(F.transform(
                        own, lambda p: p["label"]))), ",").alias("base_labels"),
                    F.array_join("labels", ",").alias("labels"), "score"))


TEMPLATES = [read_template(*t) for t in (*BASE, *MORE)]


def oracle_sql() -> str:
    """The same digest in DuckDB's SQL, by joining every word with every word of the templates."""
    words = ", ".join(f"({k}, '{t.label}', {i}, '{w}')" for k, t in enumerate(TEMPLATES)
                      for i, w in enumerate(t.words))
    phrases = ", ".join(f"({k}, {p}, {a}, {b})" for k, t in enumerate(TEMPLATES)
                        for p, (a, b) in enumerate(t.phrases))
    base = ", ".join(f"'{label}'" for label, _ in BASE)
    return rf"""
WITH t(k, label, pos, word) AS (VALUES {words}),
phrase(k, p, a, b) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
tok AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
hit AS (SELECT * FROM tok WHERE word IN (SELECT word FROM t)),
weight AS (SELECT v.word, CAST(floor(1000 * ln((2 * (SELECT count(*) FROM d) + 2)
                               / (2 * count(DISTINCT rid) + 1))) AS BIGINT) AS x
           FROM (SELECT DISTINCT word FROM t) v LEFT JOIN hit ON hit.word = v.word GROUP BY v.word),
start AS (SELECT rid, phrase.k, p, i - pos + a AS s, a, b FROM hit JOIN t USING (word)
          JOIN phrase ON phrase.k = t.k AND pos >= a AND pos < b
          GROUP BY rid, phrase.k, p, i - pos + a, a, b HAVING count(*) = b - a),
block AS (SELECT DISTINCT rid, k, p, CAST(floor((s - a) / {BLOCK}.0) AS BIGINT) + e AS c
          FROM start, (VALUES (0), (1)) AS v(e)),
agreed AS (SELECT rid, k, c FROM block GROUP BY rid, k, c
           HAVING count(*) = (SELECT count(*) FROM phrase WHERE phrase.k = block.k)),
found AS (SELECT DISTINCT rid, k, (SELECT min(label) FROM t WHERE t.k = agreed.k) AS label FROM agreed),
rare AS (SELECT k, word, x, pos, row_number() OVER (PARTITION BY k ORDER BY x DESC, word) AS r
         FROM (SELECT k, word, min(pos) AS pos FROM t GROUP BY k, word) JOIN weight USING (word)),
held AS (SELECT DISTINCT hit.rid, rare.k, rare.word, x FROM hit JOIN rare USING (word)
         JOIN agreed ON agreed.rid = hit.rid AND agreed.k = rare.k
          AND c IN (CAST(floor((i - pos) / {BLOCK}.0) AS BIGINT), CAST(floor((i - pos) / {BLOCK}.0) AS BIGINT) + 1)
         WHERE r <= {RARE}),
total AS (SELECT k, CAST(nullif(sum(x), 0) AS DOUBLE) AS all_x FROM rare WHERE r <= {RARE} GROUP BY k),
share AS (SELECT rid, k, coalesce(sum(x) / any_value(all_x), 1.0) AS y FROM held JOIN total USING (k)
          GROUP BY rid, k),
own AS (SELECT rid, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l
        FROM start JOIN found USING (rid, k) WHERE label IN ({base}) GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM found GROUP BY rid),
best AS (SELECT rid, max(y) AS y FROM share GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
       CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(own.l, '') AS base_labels, coalesce(every.l, '') AS labels, coalesce(y, 0.0) AS score
FROM d LEFT JOIN own USING (rid) LEFT JOIN every USING (rid) LEFT JOIN best USING (rid)
"""
