"""License scans by a positional rare-token index, in native expressions only.

Templates are short word sequences with a label. Document frequencies of all template words are
counted over the whole corpus; each template is indexed under its rarest half of words (highest
IDF) with their places in the template - a fixed, small index. A text's words are
scanned once for indexed words; each occurrence, moved back by its place in the template, votes
for a start, and the postings of a template's rare words are intersected on these starts. A start
that all rare words agree on is verified against the template's whole key phrase.

Words are maximal runs of characters other than ASCII non-alphanumerics, with A-Z lower-cased.
Defined cases: null and empty texts have no words, no places, empty label lists and score 0.
Everything is computed within a row, so repeated rows and ties need no rule, texts of any length are whole, and
an empty table gives no rows; only ``doc_id`` and ``text`` are read. A template whose words occur nowhere keeps the first half of its words as rare
ones. ``score`` is 1 - 0.5 ^ (number of labels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: phrases that define the base labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: fixed values: phrases of well-known notices, for the method's own labels
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
}
TEMPLATES = [(p.split(), label, p in BASE) for p, label in [*BASE.items(), *MORE.items()]]
#: ASCII characters that stand in no word, before A-Z are lower-cased
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def rare_places(documents: DataFrame, templates=None) -> list[list[int]]:
    """For each template the places of its rarest half of words, by document frequency."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for words, _, _ in templates for w in words})
    listed = F.array(*[F.lit(w) for w in vocabulary])
    df = {r["word"]: r["df"] for r in documents.select(F.explode(F.array_intersect(
        _words(F.lower("text")), listed)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    return [sorted(sorted(range(len(words)), key=lambda i, words=words: (df.get(words[i], 0), i))[:(len(words) + 1) // 2])
            for words, _, _ in templates]


def _starts(words: list[str], places: list[int]) -> Column:
    """Starts of one template: the postings of its rare words, moved back and intersected, then
    verified word by word."""
    hits = lambda i: F.transform(F.filter(F.col("rare"), lambda r: r["word"] == words[i]),
                                 lambda r: r["at"] - i)
    found = hits(places[0])
    for i in places[1:]:
        found = F.array_intersect(found, hits(i))
    phrase = F.array(*[F.lit(w) for w in words])
    same = lambda s: F.transform(F.slice(F.col("words"), s + 1, len(words)),
                                 lambda w: F.translate(w, UPPER, LOWER)) == phrase
    return F.filter(found, lambda s: (s >= 0) & F.when(s >= 0, same(s)).otherwise(False))


def scan_licenses(documents: DataFrame, templates=None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    templates = TEMPLATES if templates is None else templates
    docs = documents.select("doc_id", "text")
    places = rare_places(docs, templates)
    rare = sorted({words[i] for (words, _, _), chosen in zip(templates, places) for i in chosen})
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1),
                  lambda i: F.lower(F.get(F.col("words"), i)).isin(rare))
    looked = (docs.select("doc_id", _words(F.col("text")).alias("words"))
              .select("doc_id", "words", F.when(F.size("words") > 0, at).otherwise(F.array().cast("array<int>")).alias("ats"))
              .select("doc_id", "words", F.transform("ats", lambda i: F.struct(
                  F.translate(F.get(F.col("words"), i), UPPER, LOWER).alias("word"), i.alias("at"))).alias("rare")))
    starts = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), *[
        F.when(F.size("rare") > 0, _starts(words, chosen)).otherwise(F.array().cast("array<int>"))
        .alias(f"s{k}") for k, ((words, _, _), chosen) in enumerate(zip(templates, places))])
    base = [F.col(f"s{k}") for k, t in enumerate(templates) if t[2]]
    told = lambda only: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[
        F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, (_, label, b) in enumerate(templates) if b or not only]),
        lambda x: x.isNotNull()))), ",")
    every = F.flatten(F.array(*base)) if base else F.array().cast("array<int>")
    return (starts.select("doc_id", "n_words", every.alias("all"), told(True).alias("base_labels"),
                          told(False).alias("labels"))
            .select("doc_id", "n_words", F.size("all").cast("long").alias("n_base"),
                    F.array_min("all").cast("long").alias("first_word"),
                    F.array_max("all").cast("long").alias("last_word"), "base_labels", "labels",
                    F.when(F.col("labels") == "", 0.0).otherwise(
                        1 - F.pow(F.lit(0.5), F.size(F.split("labels", ",")))).alias("score")))


def oracle(templates=None) -> str:
    """The same rows in DuckDB SQL, by comparing every place with every phrase."""
    templates = TEMPLATES if templates is None else templates
    lists = []
    for k, (words, _, _) in enumerate(templates):
        phrase = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        lists.append(f"list_filter(range(0, len(w) - {len(words)} + 1), lambda i: w[i + 1:i + {len(words)}] = {phrase}) AS s{k}")
    base = " || ".join(f"s{k}" for k, t in enumerate(templates) if t[2])
    named = lambda only: "list_sort(list_distinct(list_filter([" + ", ".join(
        f"CASE WHEN len(s{k}) > 0 THEN '{label}' END" for k, (_, label, b) in enumerate(templates) if b or not only
    ) + "], lambda x: x IS NOT NULL)))"
    return f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n_words, {', '.join(lists)} FROM t),
        b AS (SELECT doc_id, n_words, {base} AS places, {named(True)} AS bl, {named(False)} AS al FROM p)
        SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word,
               list_max(places) AS last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
               coalesce(array_to_string(al, ','), '') AS labels, 1 - pow(0.5, len(al)) AS score
        FROM b"""
