"""Licence scan by a positional index of template words, in DataFrame expressions alone.

Licence notices are templates of words with positions.  One pass over the texts finds base
phrases and which template words a text holds.  From that come the words' document frequencies
over all documents.  Of each template the LOOKED_UP words of the highest inverse document frequency
and those of its key phrases are looked up in a text; a posting votes for where the template would
begin.  A template counts where all words of its key phrases agree on a place and the phrases stand
there, counted from it; the score is the share of the weight of what is looked up that agrees.

Only frequencies of template words come to the driver, and only postings are broadcast; both are
bounded by the templates.  Votes are grouped by row, template and place, so a long text or a
frequent notice makes no large group; only places that the key words agree on are put together, for
one text and template.

Defined cases: a null or empty text has no words, no labels and score 0; a null doc_id stays null;
repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import Scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words that are in no posting (fixed values).
STOP = frozenset("a an and any are as at be by for from in is it may not of on or that the this to under use used with without you your".split())

#: Words of a template that are looked up beside those of its key phrases.
LOOKED_UP = 6


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, and phrases that must all stand in a text."""

    label: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license", "version 2 0")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("unlicense", "free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("all-rights-reserved", "copyright all rights reserved", ("all rights reserved",)),
)


def postings(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, position) of the words that are looked up."""
    return [(w, t, i) for t, x in enumerate(templates) for i, w in enumerate(x.text.split()) if w not in STOP]


def key_phrases(template: Template) -> list[tuple[int, str]]:
    """(position, phrase) of a template's key phrases within it."""
    padded = f" {template.text} "
    return [(padded[: padded.index(f" {k} ")].count(" "), k) for k in template.keys]


def key_places(template: Template) -> set[int]:
    """The positions of a template that its key phrases take up."""
    return {at + i for at, k in key_phrases(template) for i in range(len(k.split()))}


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def spaced_words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, each after one space and the last before one; empty if none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inner = F.trim(F.regexp_replace(lower, SEPARATORS, " "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _stands(phrase: str) -> Column:
    return F.contains("norm", F.lit(f" {phrase} "))


def base_columns() -> list[Column]:
    """n_words, n_base, first_word, last_word and base_labels (an array) from ``norm``."""
    n_words = F.greatest(_spaces(F.col("norm")) - 1, F.lit(0)).cast("long")
    count = [F.when(_stands(p), F.regexp_count("norm", F.lit(f" {p}(?= )"))).otherwise(F.lit(0)) for p, _ in BASE]
    first = [F.when(_stands(p), _spaces(F.substring_index("norm", f" {p} ", 1))) for p, _ in BASE]
    last = [F.when(_stands(p), _spaces(F.col("norm")) - 1 - _spaces(F.substring_index("norm", f" {p} ", -1)) - len(p.split())) for p, _ in BASE]
    return [
        n_words.alias("n_words"),
        sum(count[1:], count[0]).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(_stands(p), F.lit(label)) for p, label in BASE))).alias("base_list"),
    ]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licences")
    index = postings(templates)
    vocabulary = sorted({w for w, _, _ in index})
    norm = docs.select("doc_id", spaced_words(F.col("text")).alias("norm"))
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("norm", " "))
    # a template needs two words, or all it has: texts with fewer need no second look
    least = min(2, *(len({w for w, x, _ in index if x == t}) for t in range(len(templates))))
    found = norm.select("doc_id", "norm", *base_columns(), held.alias("held"))
    rows = found.withColumn("norm", F.when(F.size("held") >= least, F.col("norm"))).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.table(rows, "rows")

    documents = rows.count()
    frequency = dict(map(tuple, rows.select(F.explode("held").alias("w")).groupBy("w").count().collect()))  # template words only
    idf = {w: math.log(1 + documents / frequency[w]) for w in vocabulary if frequency.get(w)}
    if not idf:
        return _result(rows.select("*", F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("best")))

    places = rows.where("norm is not null").select("row", F.posexplode(F.split(F.trim("norm"), " ")).alias("at", "w"))
    looked, about = [], []
    for t, template in enumerate(templates):
        own, keyed = [(w, pos) for w, x, pos in index if x == t], key_places(template)
        rare = sorted({w for w, _ in own}, key=lambda w: (-idf.get(w, math.log(1 + documents)), w))[:LOOKED_UP]
        voting = [(w, t, pos, idf.get(w, math.log(1 + documents)), int(pos in keyed)) for w, pos in own if w in rare or pos in keyed]
        looked += voting
        about.append((t, template.label, sum(v[4] for v in voting), math.fsum(v[3] for v in voting)))
    post = spark.createDataFrame(looked, "w string, t int, pos int, idf double, key int")
    votes = places.join(F.broadcast(post), "w")
    aligned = votes.groupBy("row", "t", (F.col("at") - F.col("pos")).alias("begin")).agg(F.sum("idf").alias("weight"), F.sum("key").alias("keys"))
    about = spark.createDataFrame(about, "t int, label string, needs int, whole double")
    whole = aligned.join(F.broadcast(about), "t").where("keys = needs")
    share = F.least(F.lit(1.0), F.col("weight") / F.col("whole"))
    best = whole.groupBy("row", "t", "label").agg(F.sort_array(F.collect_set(F.struct((-share).alias("less"), "begin"))).alias("ways"))  # places where all key words stand
    words = F.split(F.trim("norm"), " ")
    stands = lambda begin, t, x: F.forall(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(k).alias("key")) for at, k in key_phrases(x))), lambda k: F.array_join(F.slice(words, begin + k["at"] + 1, F.size(F.split(k["key"], " "))), " ") == k["key"])
    there = lambda begin: F.coalesce(*(F.when(F.col("t") == t, stands(begin, t, x)) for t, x in enumerate(templates)))
    verified = best.join(rows.where("norm is not null").select("row", "norm"), "row").withColumn("way", F.get(F.filter("ways", lambda way: there(way["begin"])), F.lit(0))).where("way is not null")
    labels = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(-F.col("way.less")).alias("best"))  # one for each template at most
    return _result(rows.drop("norm").join(labels, "row", "left"))


def _result(rows: DataFrame) -> DataFrame:
    joined = F.array_join(F.array_sort(F.array_distinct(F.concat("base_list", F.coalesce("found", F.array().cast("array<string>"))))), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base_list") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_list"), ",").alias("base_labels"), joined.alias("labels"), score.alias("score"))
