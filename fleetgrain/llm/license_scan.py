"""License scan by a positional index of rare words.

Templates are short public notices. Each of their words that is no function word has
postings (template, place). Each template is looked up by its own words with the highest
inverse document frequency, measured over all files: so many that a file without any of
them cannot hold as many of the template's words as a label needs. For the (file,
template) pairs found so, all postings of the template count: the difference between a
word's place in the file and in the template is where the template would begin, so
postings that agree on it vote for one alignment. An alignment counts if enough of the
template's rare words vote for it and the template's mandatory phrase stands in the file.
Templates do not compete, so a file gets the labels of all notices it holds.

Only files with licence words leave the first pass, and only (file, word, place) rows of
those words are shuffled. The vocabulary and the postings are fixed tables of a few
hundred rows, the only thing that is broadcast. Everything is built-in functions.

Defined cases: null or empty text has no words, no places, empty labels and score 0;
repeated rows get equal results; ties between alignments keep the larger share, labels
hold every template that passes; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose words must stand consecutively, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    """A notice, its label and the phrase without which it does not count."""

    name: str
    label: str
    mandatory: str
    text: str


# Opening words of public licence notices.
TEMPLATES = (
    Template("gpl_work", "gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl_program", "gpl", "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    Template(
        "apache_file", "apache", "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at",
    ),
    Template(
        "mit_grant", "mit", "permission is hereby granted",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template("mit_line", "mit", "mit license", "released under the mit license"),
    Template(
        "bsd_conditions", "bsd", "redistribution and use",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    Template(
        "cc_by_work", "cc-by", "creative commons attribution",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
)
#: Words that carry no evidence.
PLAIN = frozenset(
    "a and any are as at by can either in is it may met not of on or person that the this to under use with without you your 0 2 3 4".split()
)
#: Agreeing words that are full evidence of a template; shorter ones need all their rare words for it.
FULL_EVIDENCE = 12
#: Share of the full evidence that must agree on one alignment.
LEAST_SHARE = 0.6


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings() -> list[tuple[str, int, str, str, int]]:
    """(word, place, template, label, rare words of the template) of all templates."""
    out = []
    for t in TEMPLATES:
        words = t.text.split()
        rare = [(w, i) for i, w in enumerate(words) if w not in PLAIN]
        out += [(w, i, t.name, t.label, len({w for w, _ in rare})) for w, i in rare]
    return out


def vocabulary() -> list[str]:
    return sorted({w for w, *_ in postings()})


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def at(i: Column) -> Column:
        holds = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            holds = holds & (F.get(words, i + k) == part)
        return holds

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<int>"))


def _candidate_words(lower: Column) -> Column:
    """Words of the texts that hold any licence word; other texts need only their number."""
    probe = "(?:" + "|".join(sorted({w for p, _ in PHRASES for w in p.split()} | set(vocabulary()))) + ")"
    edge = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
    return F.when(lower.rlike(f"(?:^|[{edge}]){probe}(?:$|[{edge}])"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))


def index_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, stored: doc_id, n_words, base places by label, licence words by place, mandatory phrases."""
    slim = docs.select(F.col(id_col).alias("doc_id"), _lower(F.col(text_col)).alias("lower"))
    words = slim.select("doc_id", F.regexp_count("lower", F.lit(WORD)).cast("long").alias("n_words"), _candidate_words(F.col("lower")).alias("words"))
    vocab = vocabulary()
    places = {f"at_{i}": _phrase_places(F.col("words"), p) for i, (p, _) in enumerate(PHRASES)}
    hits = F.filter(
        F.transform(F.col("words"), lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("pos"))), lambda x: x["word"].isin(*vocab)
    )
    mandatory = sorted({t.mandatory for t in TEMPLATES})
    held = F.array_compact(
        F.array(*[F.when(F.size(_phrase_places(F.col("words"), m)) > 0, F.lit(m)) for m in mandatory])
    )
    return stored(words.select("doc_id", "n_words", *[c.alias(k) for k, c in places.items()], hits.alias("hits"), held.alias("held")), "license-files")


def seeds(df: dict[str, int]) -> list[tuple[str, str, list[str]]]:
    """(template, mandatory phrase, seed words): of the words that an alignment needs, one is a seed at least.

    Of n rare words a label needs k, so any n - k + 1 of them do; `df`, the number of
    files by word, makes them the rarest.
    """
    out = []
    for t in TEMPLATES:
        rare = sorted({w for w in t.text.split() if w not in PLAIN}, key=lambda w: (df.get(w, 0), w))
        full = min(len(rare), FULL_EVIDENCE)
        least = next(v for v in range(1, full + 1) if v / full >= LEAST_SHARE)
        out.append((t.name, t.mandatory, rare[: len(rare) - least + 1]))
    return out


def align(files: DataFrame) -> DataFrame:
    """Templates that stand in each file: doc_id, label, score."""
    spark = files.sparkSession
    some = files.where((F.size("hits") > 0) & (F.size("held") > 0))
    distinct = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    # at most one row per word of the vocabulary
    df = {r.word: r.n for r in distinct.groupBy("word").agg(F.count("*").alias("n")).collect()}
    found_by = spark.createDataFrame(seeds(df), "template string, mandatory string, seeds array<string>")
    pairs = some.join(
        F.broadcast(found_by),
        F.array_contains("held", F.col("mandatory")) & F.arrays_overlap(F.transform("hits", lambda h: h["word"]), F.col("seeds")),
    )
    posts = spark.createDataFrame(postings(), "word string, place long, template string, label string, n_rare long")
    votes = (
        pairs.select("doc_id", "template", F.explode("hits").alias("h"))
        .select("doc_id", "template", "h.word", "h.pos")
        .join(F.broadcast(posts), ["template", "word"])
        .groupBy("doc_id", "template", "label", "n_rare", (F.col("pos") - F.col("place")).alias("begin"))
        .agg(F.count_distinct("word").alias("votes"))
    )
    full = F.least(F.col("n_rare"), F.lit(FULL_EVIDENCE))
    return (
        votes.select("doc_id", "label", F.least(F.col("votes") / full, F.lit(1.0)).alias("share"))
        .groupBy("doc_id", "label")
        .agg(F.max("share").alias("score"))
        .where(F.col("score") >= LEAST_SHARE)
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per file: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    files = index_files(docs, id_col, text_col)
    found = align(files).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    arrays = [F.coalesce(F.col(f"at_{i}"), F.array().cast("array<int>")) for i in range(len(PHRASES))]
    places = F.concat(*arrays)
    base = F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(arrays, PHRASES, strict=True)]))
    joined = files.withColumns({"places": places, "base": F.array_distinct(base)}).select("doc_id", "n_words", "places", "base").join(found, "doc_id", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
