"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates."""

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import alnum_words, per_row

# Phrases with the label that each gives, and notices of public licenses: label, words without which a
# block is not of this license, whatever else it shares with it, and the words of the notice.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "mit", "released under the mit license"),
    ("mit", "granted charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sell furnished", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache", "apache", "licensed under the apache license version 2 0"),
    ("apache", "compliance obtain", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "gnu general", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "fee granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8

FOUND_DDL = "doc_id long, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<word:long,end:long,label:string,containment:double>>"
FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("blocks", pa.list_(pa.struct([("word", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
    ]
)


@dataclass(frozen=True, eq=False)
class Template:
    label: str
    length: int  # words of the notice, and so of a block
    required: frozenset[bytes]
    tokens: tuple[bytes, ...]  # distinct words in the global order, rarest first
    need: int  # smallest overlap that meets the threshold

    @property
    def prefix(self) -> tuple[bytes, ...]:
        """A block with `need` of the tokens has at least one of these."""
        return self.tokens[: len(self.tokens) - self.need + 1]

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(start, end, containment) of every block of `words` that meets the threshold.

        Only blocks with a prefix token are looked at; along a run of these one word comes in and one goes out.
        """
        n = len(words)
        length = min(self.length, n)
        tokens, prefix = frozenset(self.tokens), frozenset(self.prefix)
        count: dict[bytes, int] = {}
        held = -2  # the start that `count` is for

        def more(w: bytes, by: int) -> None:
            if w in tokens:
                count[w] = count.get(w, 0) + by
                if not count[w]:
                    del count[w]

        for at in [k for k, w in enumerate(words) if w in prefix]:
            for start in range(max(held + 1, at - length + 1, 0), min(at, n - length) + 1):
                if start == held + 1:
                    more(words[held], -1)
                    more(words[held + length], 1)
                else:
                    count.clear()
                    for w in words[start : start + length]:
                        more(w, 1)
                held = start
                if len(count) >= self.need and self.required <= count.keys():
                    yield start, start + length, len(count) / len(self.tokens)


class TemplateIndex:
    """Templates found by their prefix tokens, with tokens ordered by document frequency over the whole corpus."""

    def __init__(self, templates: list[tuple[str, str, str]], frequency: dict[bytes, int], threshold: float):
        self.rank = {t: k for k, t in enumerate(sorted(vocabulary(templates), key=lambda t: (frequency.get(t, 0), t)))}
        self.by_token: dict[bytes, list[tuple[int, Template]]] = defaultdict(list)
        for label, required, text in templates:
            words = alnum_words(text.encode())
            tokens = tuple(sorted(set(words), key=self.rank.__getitem__))
            template = Template(label, len(words), frozenset(alnum_words(required.encode())), tokens, math.ceil(threshold * len(tokens) - 1e-9))
            for at, token in enumerate(template.prefix):
                self.by_token[token].append((at, template))
        self.first = frozenset(self.by_token)

    def candidates(self, words: list[bytes]) -> Iterator[Template]:
        """Templates of which the words may hold a block."""
        held = set(words)
        known = sorted((t for t in held if t in self.rank), key=self.rank.__getitem__)
        seen: set[int] = set()
        for k, token in enumerate(known):
            for at, template in self.by_token.get(token, ()):
                if id(template) in seen:
                    continue
                seen.add(id(template))  # the first common token decides, so later ones need no other look
                left = min(len(template.tokens) - at, len(known) - k)
                if len(held) >= template.need and left >= template.need and template.required <= held:  # length and positional filters
                    yield template

    def match(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(start, end, label, containment) of blocks that meet the threshold, in order; see find_licenses()."""
        if self.first.isdisjoint(words):
            return []
        found = sorted((s, e, t.label, c) for t in self.candidates(words) for s, e, c in t.blocks(words))
        return _best(found)


def _best(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Blocks that share no word with one of a higher containment; `found` is in order of start."""
    longest = max((e - s for s, e, _, _ in found), default=0)
    out, first = [], 0
    for k, (start, end, label, c) in enumerate(found):
        while found[first][0] <= start - longest:
            first += 1
        j = first
        while j < len(found) and found[j][0] < end and not (found[j][1] > start and found[j][3] > c):
            j += 1
        if j == len(found) or found[j][0] >= end:
            out.append((start, end, label, c))
    return out


def vocabulary(templates: list[tuple[str, str, str]]) -> set[bytes]:
    return {t for _, _, text in templates for t in alnum_words(text.encode())}


def token_frequency(docs: DataFrame, templates: list[tuple[str, str, str]]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template token; as many rows as the templates have tokens."""
    known = frozenset(vocabulary(templates))

    def count(rows):
        n: dict[bytes, int] = defaultdict(int)
        for (text,) in rows:
            for t in known.intersection(alnum_words(text)):
                n[t] += 1
        for t, k in n.items():
            yield t, k

    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
    counted = docs.select("text").mapInArrow(per_row(count, schema), "token binary, n long")
    return {bytes(t): n for t, n in counted.groupBy("token").agg(F.sum("n")).collect()}


def find_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """License phrases and blocks of each document: (doc_id, n_words, places, blocks).

    places are all words at which a phrase begins. A block is a run of as many words as a template's notice has, or all
    words of a shorter text, wherever lines end. It is of the template if it holds at least `threshold` of the
    template's distinct words, the required ones among them; containment is their share. A block that shares a word with
    another one of a higher containment gives way to it, so the best template names a passage; on ties all do. One row
    comes back for each input row, repeated rows included; null or empty text has no words; an empty table gives an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = TemplateIndex(templates, token_frequency(docs, templates), threshold)
    said = [(p.encode().split(), label) for p, label in phrases.items()]

    def find(rows):
        ends: dict[bytes, list] = defaultdict(list)
        for words, label in said:
            ends[words[-1]].append((words, label))
        watched = index.first | ends.keys()
        for doc_id, text in rows:
            words = alnum_words(text)
            places, blocks = [], []
            if not watched.isdisjoint(words):
                for at, w in enumerate(words):
                    for phrase, label in ends.get(w, ()):
                        start = at - len(phrase) + 1
                        if start >= 0 and words[start : at + 1] == phrase:
                            places.append({"word": start, "label": label})
                blocks = [{"word": s, "end": e, "label": label, "containment": c} for s, e, label, c in index.match(words)]
            yield doc_id, len(words), places, blocks

    return docs.mapInArrow(per_row(find, FOUND), FOUND_DDL)


def digest(found: DataFrame) -> DataFrame:
    starts, base = F.col("places.word"), F.col("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("blocks.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
