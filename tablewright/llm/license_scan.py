"""Licence notices by a positional rare-token index."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm._spark import numbered

#: Separators of words after A-Z became a-z: every other ASCII character.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed values: (label, notice, phrase of it that must be there), one-line
#: notices first, then the opening words of the public licences' own headers.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification",
    ),
    (
        "gpl-2.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "gnu general public license as published by the free software foundation either version 2 of the license",
    ),
    (
        "gpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "gnu general public license as published by the free software foundation either version 3 of the license",
    ),
    (
        "lgpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
        "gnu lesser general public license as published by the free software foundation either version 3 of the license",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license v 2 0"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _key_start(notice: str, phrase: str) -> int:
    words, key = notice.split(), phrase.split()
    for start in range(len(words) - len(key) + 1):
        if key and words[start : start + len(key)] == key:
            return start
    raise ValueError(f"the notice {notice!r} does not hold its key phrase {phrase!r}")


def scan_licenses(
    docs: DataFrame, templates: Iterable[tuple[str, str, str]] = TEMPLATES, rarest: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``templates`` are (label, notice, key phrase), any number of any length; a
    label may have several.  One pass turns each text into words, counts the
    base phrases, and keeps the distinct template words that a text holds;
    those give every word's document frequency.  The index holds, for each
    template, the ``rarest`` words of highest IDF of its own key phrase with
    their positions.  A text's index words give postings (template, begin);
    where all index words of a template agree on one begin, the template is a
    candidate, and it stands when every word of its key phrase is in place.  A
    notice that stands holds all its index words, so none is passed over,
    whatever else its document holds.  Score is the best standing candidate's
    share of notice words in place, 0.5 where only a base label was found.

    Positions are kept for texts that hold the longest word of some key phrase;
    no other can hold a whole one.

    Null or empty text has no words.  A document without a label has score 0 and
    empty label strings.  Long texts are one row and are never cut.  Repeated
    rows and equal ids are scanned separately, ids may be null, ties of
    frequency go by word.  An empty table gives an empty result.
    """
    templates = [(label, notice.split(), _key_start(notice, phrase), len(phrase.split())) for label, notice, phrase in templates]
    vocabulary = sorted({w for _, words, _, _ in templates for w in words})
    number = {w: j for j, w in enumerate(vocabulary)}
    size = max(1, len(vocabulary))
    longest = sorted({max(words[b : b + n], key=lambda w: (len(w), w)) for _, words, b, n in templates})
    spark = docs.sparkSession
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), upper, lower)
    joined = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), SEPARATORS, " ").alias("s"))
    s = F.col("s")
    n_words = _spaces(s) - 1
    found, first, last, named = [], [], [], []
    for phrase, label in BASE:
        inner = f" {phrase} "
        there = s.contains(inner)
        found.append(F.when(there, F.regexp_count(s, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, _spaces(F.substring_index(s, inner, 1))))
        last.append(F.when(there, n_words - _spaces(F.substring_index(s, inner, -1)) - len(phrase.split())))
        named.append(F.when(there, F.lit(label)))
    words = F.split(F.trim(s), " ")
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    some = F.array(*[F.lit(w) for w in longest]).cast("array<string>")
    # A hit is position * size + number of the word: one long.
    code = lambda w, i: F.when(w.isin(vocabulary), i.cast("long") * size + F.array_position(known, w) - 1)
    looked = numbered(
        joined.select(
            "doc_id",
            n_words.cast("long").alias("n_words"),
            reduce(lambda a, b: a + b, found).cast("long").alias("n_base"),
            F.least(*first).cast("long").alias("first_word"),
            F.greatest(*last).cast("long").alias("last_word"),
            F.array_compact(F.array(*named)).alias("base"),
            F.array_intersect(words, known).alias("held"),
            words.alias("words"),
        ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "held", F.when(F.arrays_overlap("held", some), F.array_compact(F.transform("words", code))).alias("hits")),
        "row",
    )
    frequency = {r["word"]: r["n"] for r in looked.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per template word
    index, expected = [], []
    for t, (label, notice, begin, length) in enumerate(templates):
        key = range(begin, begin + length)
        rare = sorted(key, key=lambda at: (frequency.get(notice[at], 0), notice[at], at))[: max(1, rarest)]
        index += [(number[notice[at]], t, at, len(rare)) for at in rare]
        codes = [at * size + number[w] for at, w in enumerate(notice)]
        expected.append((t, label, codes, [codes[at] for at in key]))
    index_words = sorted({x[0] for x in index})
    postings = spark.createDataFrame(index, "word int, template int, at int, needed int")
    wanted = spark.createDataFrame(expected, "template int, label string, notice array<long>, key array<long>")
    rare_hits = F.filter("hits", lambda h: (h % size).isin(index_words))
    placed = (
        looked.where("hits is not null")
        .select("row", F.explode(rare_hits).alias("hit"))
        .select("row", F.expr(f"hit div {size}").alias("position"), (F.col("hit") % size).cast("int").alias("word"))
        .join(F.broadcast(postings), "word")  # at most ``rarest`` rows for each template
        .withColumn("begin", F.col("position") - F.col("at"))
    )
    candidates = placed.groupBy("row", "template", "begin").agg(F.count(F.lit(1)).alias("agreeing"), F.first("needed").alias("needed")).where("agreeing = needed")
    shifted = lambda codes: F.transform(codes, lambda c: c + F.col("begin") * size)
    standing = (
        candidates.join(looked.where("hits is not null").select("row", "hits"), "row")
        .join(F.broadcast(wanted), "template")  # a row for each template
        .where(F.size(F.array_intersect(shifted("key"), "hits")) == F.size("key"))
        .withColumn("share", F.size(F.array_intersect(shifted("notice"), "hits")) / F.size("notice"))
        .groupBy("row")
        .agg(F.collect_set("label").alias("own"), F.max("share").alias("score"))
    )
    merged = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return looked.drop("held", "hits").join(standing, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", merged).alias("labels"),
        F.coalesce("score", F.when(F.size("base") > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
    )
