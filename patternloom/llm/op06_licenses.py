"""License scans: a file's rarest licence words look up the templates' postings, which meet by relative position; key phrases decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import ALNUM, map_chunks, offsets, prepare, read

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: label, template, mandatory key phrase. Fixed wordings of the licences' own notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("apache-2.0", "licensed under the apache 2 0 license", "apache 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by-nc", "attribution noncommercial", "attribution noncommercial"),
)
#: Labels by the identifiers that stand behind `SPDX` or `SPDX-License-Identifier`: templates are made of them.
IDENTIFIERS = {"mit": "mit", "apache 2 0": "apache-2.0", "bsd": "bsd", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl 2 0": "mpl-2.0", "isc": "isc", "cc0": "cc0", "unlicense": "unlicense", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc"}
ALL = (*TEMPLATES, *((label, f"{front} {name}", f"{front.split()[-1]} {name}") for name, label in IDENTIFIERS.items() for front in ("spdx license identifier", "spdx")))
#: Words that turn a mention around, where one stands at most so many words before a key phrase.
NEGATIONS, REACH = ("not", "never", "nor"), 3
#: Distinct licence words of a file that are looked up, the rarest ones, besides each possible template's two rarest key words.
RAREST = 8
#: Postings that are brought together at once.
POSTINGS = 1 << 20


class Rules:
    """Word numbers, phrases and templates."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        number = lambda s: np.array([self.ids.setdefault(w.encode(), len(self.ids) + 1) for w in s.split()])
        self.base = [(number(p), label) for p, label in PHRASES]
        self.templates = [(label, number(t), number(key)) for label, t, key in ALL]
        keys = [tuple(key.tolist()) for _, _, key in self.templates]
        #: For each template the longer key phrases that begin with its own: a place of one of these is none of its own.
        self.longer = [sorted({k for k in keys if len(k) > len(key) and k[: len(key)] == key}) for key in keys]
        self.key_at = [next(i for i in range(len(t)) if tuple(t[i : i + len(key)]) == tuple(key)) for _, t, key in self.templates]
        self.negations = number(" ".join(NEGATIONS))
        self.size = len(self.ids) + 1
        rows = sorted((int(w), k, o) for k, (_, t, _) in enumerate(self.templates) for o, w in enumerate(t))
        #: The postings: for each word the templates and offsets where it stands.
        self.first = np.searchsorted([w for w, _, _ in rows], np.arange(self.size + 1))
        self.template, self.offset = np.array([k for _, k, _ in rows]), np.array([o for _, _, o in rows])


def numbered(rules: Rules, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, 0 for other words, with a 0 after each text, and the texts' word counts."""
    lists = [t.translate(ALNUM).split() for t in texts]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    off = offsets(lens + 1)
    out, get, zero = np.zeros(int(off[-1]) + 64, np.int16), rules.ids.get, (0,).__mul__
    for w, a in zip(lists, off, strict=False):
        out[a : a + len(w)] = np.fromiter(map(get, w, zero(len(w))), np.int16, len(w))
    return out, lens


def places(words: np.ndarray, phrase: np.ndarray, first: int = 0) -> np.ndarray:
    """Where the phrase starts; its word at first is looked up, the others are compared there."""
    at = np.flatnonzero(words[: len(words) - 64] == phrase[first]) - first
    at = at[at >= 0]
    for j, w in enumerate(phrase):
        at = at[words[at + j] == w]
    return at


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[int, dict[int, int]]:
    """The number of documents and of those with each licence word, over the whole table."""
    prepare(docs.sparkSession)

    def once():
        rules = Rules()

        def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
            words, lens = numbered(rules, texts)
            at = np.flatnonzero(words)
            doc = np.searchsorted(offsets(lens + 1), at, "right") - 1
            each = np.unique(doc * 4096 + words[at])
            n = np.bincount(each % 4096, minlength=1)
            n[0] = len(texts)
            used = np.flatnonzero(n)
            return pa.table({"word": pa.array(used), "n": pa.array(n[used])})

        return step

    rows = map_chunks(docs.select(text), text, None, "word long, n long", once=once).groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each licence word at most
    df = {r.word: r.n for r in rows}
    return df.pop(0, 0), df


def aligned(rules: Rules, idf: np.ndarray, words: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(templates, places): where a template may begin, as at least two of a file's looked-up words agree in it.

    A file looks up its RAREST licence words by inverse document frequency, and of each template whose key phrase's words it all
    has the two rarest of these: so no place of a key phrase is missed, however many licences a file names. A file that has no
    template's key words looks up none.
    """
    at = np.flatnonzero(words[: len(words) - 64])
    if not len(at):
        return
    doc = np.searchsorted(off, at, "right") - 1
    present = np.zeros((len(off) - 1, rules.size), bool)
    present[doc, words[at]] = True
    order = np.argsort(-idf, kind="stable")
    asked = np.zeros_like(present)
    asked[:, order] = present[:, order] & (np.cumsum(present[:, order], axis=1) <= RAREST)
    possible = np.zeros(len(present), bool)
    for _, _, key in rules.templates:
        has = present[:, key].all(axis=1)
        possible |= has
        rare = np.unique(key)[np.argsort(-idf[np.unique(key)], kind="stable")[:2]]
        asked[np.ix_(has, rare)] = True
    asked[~possible] = False
    at = at[asked[doc, words[at]]]
    n = rules.first[words[at] + 1] - rules.first[words[at]]
    parts = np.cumsum(n) // POSTINGS
    margin, found = 256, []
    for part in np.split(at, np.flatnonzero(np.diff(parts)) + 1):
        k = rules.first[words[part] + 1] - rules.first[words[part]]
        row = np.repeat(rules.first[words[part]], k) + np.arange(int(k.sum())) - np.repeat(offsets(k)[:-1], k)
        found.append(rules.template[row] * (len(words) + 2 * margin) + np.repeat(part, k) - rules.offset[row] + margin)
        found = [np.sort(np.concatenate(found))] if len(found) > 8 else found
    keys, count = np.unique(np.concatenate(found), return_counts=True)
    keys = keys[count >= 2]
    yield keys // (len(words) + 2 * margin), keys % (len(words) + 2 * margin) - margin


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __words, __base (places of base phrases), __first, __last, __base_labels, __labels and __score.

    A null or empty text has no words and no labels. Where the looked-up words of a file agree on a template's place (see
    aligned()) and its key phrase stands there, the template's label is told, unless another template's longer phrase begins
    with that one or a negation stands up to REACH words before it; the score is the part of the template's words that agree.
    Columns of docs that begin with two underscores are left out.
    """
    count, df = document_frequency(docs, text)
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema if not f.name.startswith("__")]

    def once():
        rules = Rules()
        idf = np.zeros(rules.size)
        for w in range(1, rules.size):
            idf[w] = np.log((count + 1) / (df.get(w, 0) + 1))

        def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
            words, lens = numbered(rules, texts)
            off = offsets(lens + 1)
            n = len(texts)
            total, first, last = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            for phrase, label in rules.base:
                at = places(words, phrase)
                doc = np.searchsorted(off, at, "right") - 1
                np.add.at(total, doc, 1)
                np.minimum.at(first, doc, at - off[doc])
                np.maximum.at(last, doc, at - off[doc])
                for d in set(doc.tolist()):
                    base[d].add(label)
            labels, scores = [set(x) for x in base], np.array([1.0 if x else 0.0 for x in base])
            for which, begin in aligned(rules, idf, words, off):
                for k in np.unique(which).tolist():
                    label, t_words, key = rules.templates[k]
                    at = begin[which == k]
                    at = at[at + rules.key_at[k] >= 0] + rules.key_at[k]
                    for j, w in enumerate(key):
                        at = at[words[np.minimum(at + j, len(words) - 1)] == w]
                    for longer in rules.longer[k]:
                        at = at[(words[at[:, None] + np.arange(len(longer))] != longer).any(axis=1)]
                    doc = np.searchsorted(off, at, "right") - 1
                    before = at[:, None] - np.arange(1, REACH + 1)
                    denied = np.isin(words[np.maximum(before, 0)], rules.negations) & (before >= off[doc][:, None])
                    at, doc = at[~denied.any(axis=1)], doc[~denied.any(axis=1)]
                    p = at[:, None] - rules.key_at[k] + np.arange(len(t_words))
                    inside = (p >= off[doc][:, None]) & (p < off[doc + 1][:, None])
                    np.maximum.at(scores, doc, ((words[np.clip(p, 0, len(words) - 1)] == t_words) & inside).mean(axis=1))
                    for d in np.unique(doc).tolist():
                        labels[d].add(label)
            none = total == 0
            for name, column in (("__words", pa.array(lens)), ("__base", pa.array(total)), ("__first", pa.array(first, mask=none)), ("__last", pa.array(last, mask=none)), ("__base_labels", pa.array([",".join(sorted(x)) for x in base])), ("__labels", pa.array([",".join(sorted(x)) for x in labels])), ("__score", pa.array(np.clip(scores, 0, 1)))):
                t = t.append_column(name, column)
            return t

        return step

    schema = ", ".join([*(f"`{n}` {t}" for n, t in fields), "__words long, __base long, __first long, __last long, __base_labels string, __labels string, __score double"])
    return map_chunks(docs.select(*(F.col(f"`{n}`") for n, _ in fields)), text, None, schema, once=once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(a).alias(b) for a, b in (("__words", "n_words"), ("__base", "n_base"), ("__first", "first_word"), ("__last", "last_word"), ("__base_labels", "base_labels"), ("__labels", "labels"), ("__score", "score"))))


def brute(text: str | None) -> tuple[int, int, str, str]:
    """(words, places of base phrases, base labels, labels) by comparing slices, for tests."""
    w = (text or "").encode().translate(ALNUM).decode().split()
    at = lambda p: [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    found = [(label, len(at(p.split()))) for p, label in PHRASES]
    base = {label for label, n in found if n}
    keys = [key.split() for _, _, key in ALL]
    denied = lambda i: any(x in NEGATIONS for x in w[max(0, i - REACH) : i])
    more = {label for label, _, key in ALL for i in at(key.split()) if not denied(i) and not any(len(k) > len(key.split()) and w[i : i + len(k)] == k and k[: len(key.split())] == key.split() for k in keys)}
    return len(w), sum(n for _, n in found), ",".join(sorted(base)), ",".join(sorted(base | more))
