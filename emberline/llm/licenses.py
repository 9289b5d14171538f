"""Operator 8: licence scan by phrases and by an exact set-similarity join of text blocks with licence templates.

A-Z is lower-cased and words are runs of ``ALNUM_WORD``. Base labels come from phrases whose words stand consecutively.
The join finds every block (paragraph: text between empty lines) whose words hold at least ``CONTAINMENT`` of a
template's distinct words: tokens are ordered by their frequency over all documents, rarest first; a block is a
candidate only if it holds a token of the template's prefix (one of the first |T| - need + 1, found through an inverted
index) and is long enough; from the first common token on, the pair is given up as soon as what is left in either list
cannot reach the need. These filters are exact; what they let through is counted fully. Templates are a parameter: rows
(label, text), ``TEMPLATES`` where none are given. They travel to the tasks, so their size is checked (``TEMPLATE_CHARS``).

score is 1 where a phrase stands, else the best containment of the blocks found, else 0. Null and empty texts have no
words, no labels and score 0; very long texts are scanned whole; repeated rows are scanned as often as they occur; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import judged, small_batches
from .decontamination import normalised_words

CONTAINMENT = 0.8
TEMPLATE_CHARS = 50_000_000
#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Standard notices of common licences.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def template_sets(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, t) for label, text in templates if (t := frozenset(normalised_words(text)))]


def token_frequencies(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    """Documents that hold each template token, over all documents; the tokens are those of the templates, so bounded."""
    vocabulary = frozenset().union(*(t for _, t in template_sets(templates)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                n.update(vocabulary.intersection(normalised_words(text)))
        if n:
            yield pd.DataFrame({"token": [t.decode("latin-1") for t in n], "n": list(n.values())})

    rows = docs.select("text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"].encode("latin-1"): r["n"] for r in rows}


class Templates:
    """Templates with tokens in global order under an inverted index of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[bytes, int]) -> None:
        self.rank = lambda t: (frequency.get(t, 0), t)
        self.all: list[tuple[str, list[bytes], int]] = []
        self.under: dict[bytes, list[int]] = {}
        for label, tokens in template_sets(templates):
            need = math.ceil(CONTAINMENT * len(tokens) - 1e-9)
            ordered = sorted(tokens, key=self.rank)
            for t in ordered[: len(ordered) - need + 1]:
                self.under.setdefault(t, []).append(len(self.all))
            self.all.append((label, ordered, need))
        self.vocabulary = frozenset().union(*(o for _, o, _ in self.all))

    def found(self, text: str | None, words: list[bytes]) -> dict[str, float]:
        """Best containment per label of the blocks that meet the threshold."""
        out: dict[str, float] = {}
        if self.under.keys().isdisjoint(words):
            return out
        for block in text.split("\n\n"):
            held = self.vocabulary.intersection(normalised_words(block))
            candidates = {i for t in held for i in self.under.get(t, ())}
            b = sorted(held, key=self.rank) if candidates else []
            for label, t, need in (self.all[i] for i in candidates):
                if len(b) >= need and (n := overlap(t, b, need, self.rank)) >= need:
                    out[label] = max(out.get(label, 0.0), n / len(t))
        return out


def overlap(t: list[bytes], b: list[bytes], need: int, rank) -> int:
    """Common tokens of two lists in global order, or 0 once ``need`` is out of reach."""
    i = j = n = 0
    while i < len(t) and j < len(b):
        if n + min(len(t) - i, len(b) - j) < need:
            return 0
        if t[i] == b[j]:
            i, j, n = i + 1, j + 1, n + 1
        elif rank(t[i]) < rank(b[j]):
            i += 1
        else:
            j += 1
    return n


def phrase_places(words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places, first and last start word, and labels of the phrases."""
    line, n, starts, labels = b" " + b" ".join(words) + b" ", 0, [], set()
    for phrase, label in PHRASES:
        p = b" " + phrase.encode() + b" "
        at = line.find(p)
        while at >= 0:
            n += 1
            labels.add(label)
            starts.append(line.count(b" ", 0, at))
            at = line.find(p, at + 1)
    return n, min(starts, default=None), max(starts, default=None), labels


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    if sum(len(text) for _, text in templates) > TEMPLATE_CHARS:
        raise ValueError(f"templates of more than {TEMPLATE_CHARS} characters: scan with one part of them at a time")
    docs = small_batches(docs.select("doc_id", "text"))
    frequency = docs.sparkSession.sparkContext.broadcast(token_frequencies(docs, templates))

    def setup():
        known = Templates(templates, frequency.value)

        def scan(texts: list) -> tuple[list]:
            rows = []
            for text in texts:
                words = normalised_words(text)
                n, first, last, base = phrase_places(words)
                more = known.found(text, words)
                score = 1.0 if n else max(more.values(), default=0.0)
                rows.append({"n_words": len(words), "n_base": n, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more.keys())), "score": score})
            return (rows,)

        return scan

    made = "found struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double>"
    return judged(docs, ["doc_id"], made, setup).select("doc_id", "found.*")


def oracle() -> str:
    """The same scan as DuckDB SQL, by counting every block against every template."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all(" + fold + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', [{', '.join(repr(w.decode()) for w in sorted(t))}])" for label, t in template_sets())
    return f"""
WITH phrases(phrase, label, m) AS (VALUES {phrases}), templates(label, tokens) AS (VALUES {templates}),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({words.format("text")}, []) AS w FROM documents),
p AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, phrase, label, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, phrases) WHERE array_to_string(list_slice(w, i, i + m - 1), ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi FROM p GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct({words.format("block")}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS block FROM d)),
c AS (SELECT doc_id, label, len(list_intersect(w, tokens)) AS n, len(tokens) AS size FROM blocks, templates),
found AS (SELECT doc_id, label, max(n / size) AS score FROM c WHERE n >= ceil({CONTAINMENT} * size - 1e-9) GROUP BY doc_id, label),
base_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM p) GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce(base_labels.s, '') AS base_labels, coalesce(labels.s, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN base_labels USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""
