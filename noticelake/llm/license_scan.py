"""Operator 4: licence families of paragraphs by a trained classifier.

A sparse logistic regression over hashed word n-grams (one to three words) tells
licence families apart, with a class of its own for what is no licence text. It is
trained on the templates below: on their sentences, on windows of their words, on
variants with words left out, and, for the unknown class, on paragraphs made from
the same words in another order. Its probabilities are calibrated by a temperature
fitted on variants that it was not trained on. A prediction counts only for a window
of words that agrees with a template of that family: a template phrase stands in it
whole, or ``TEMPLATE_SHARE`` of the template's word pairs, one of them in no other
family's templates, stand in a window of at most ``SPREAD`` times its length.

A paragraph is a run of lines with other characters than white space, read over its
line ends. The classifier reads every paragraph whole, in windows of ``WIDTHS`` words at
every place; no keyword comes before it. Where a window's odds against the unknown class
reach ``CANDIDATE``, a low bar, the paragraph is compared with the templates, and what
agrees gets the classifier's calibrated probability. So a text may be wrapped, or stand in
a long line. A window is no share of a template where its word pairs belong to a whole
phrase of another family. Each family that stands in a paragraph is reported, with the line
where its most probable window begins; overlapping windows of a family are one place.

Defined results: a null or empty text has no licences; repeated rows give repeated
results; a family counts once a line; ties in probability go to the family first in order
of name; results are in order of line and name; other columns pass through. Texts are read
whole, long ones in one piece.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import bounded_batches, fresh, whole_text

#: Families and phrases that declare them (fixed values).
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2.0",
        "apache license 2.0",
        "spdx license identifier apache 2.0",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files to deal in the software without restriction",
    ),
    "bsd": (
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met redistributions of source code must retain the above copyright notice",
        "bsd 3 clause license",
        "bsd 2 clause license",
        "bsd 2 clause simplified license",
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
        "gnu general public license",
        "spdx license identifier gpl 2.0",
        "spdx license identifier gpl 3.0",
    ),
    "lgpl": (
        "gnu lesser general public license",
        "licensed under the gnu lesser general public license version 3",
        "spdx license identifier lgpl 2.1",
        "spdx license identifier lgpl 3.0",
    ),
    "agpl": ("gnu affero general public license", "licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0"),
    "isc": (
        "isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
        "spdx license identifier isc",
    ),
    "mpl-2.0": (
        "mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "spdx license identifier mpl 2.0",
    ),
    "cc-by": ("cc by 4.0", "licensed under cc by 4.0", "creative commons attribution 4.0 international license"),
    "cc-by-sa": ("cc by sa 4.0", "licensed under cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"),
    "cc-by-nc": ("cc by nc 4.0", "licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"),
    "cc0": ("cc0 1.0 universal public domain dedication", "dedicated to the public domain under cc0 license"),
    "proprietary": ("all rights reserved", "proprietary and confidential all rights reserved license required"),
}
UNKNOWN = "unknown"
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
#: Words of the classifier's windows, and the least log odds of a family against the unknown class for a closer look.
WIDTHS, CANDIDATE = (2, 3, 5, 8, 16, 32), -3.0
#: Words that one step of the classifier reads.
STEP_WORDS = 50_000
#: Words of a window, for each word of a template whose share it holds.
SPREAD = 2
#: Slots of the hashed n-grams, the least calibrated probability, and the share of a long template that must stand in a paragraph.
SLOTS, MIN_PROBABILITY, TEMPLATE_SHARE, PHRASE_WORDS = 1 << 13, 0.5, 0.6, 12
VARIANTS, STEPS, SEED = 12, 150, 20240101
#: Prose that is no licence and shares no words with one is made of these.
SYLLABLES = "ba da fo ga ki lo mu ne pa ri so ta ve wo za sten dor lin mar".split()
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")
RESULT = T.ArrayType(
    T.StructType().add("line", T.IntegerType()).add("family", T.StringType()).add("probability", T.DoubleType())
)


def line_words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


class _WordHashes(dict):
    """Hashes of words, made when missing, within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


_hashes = _WordHashes()


def gram_slots(words: list[str]) -> list[np.ndarray]:
    """Slots of the one-, two- and three-word n-grams at each place."""
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    out, value = [], np.zeros(len(h), dtype=np.uint64)
    for n in range(3):
        value = value[: len(h) - n] if n else value
        value = (value ^ (h[n:] + np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
        value = value ^ (value >> np.uint64(29))
        out.append((value % np.uint64(SLOTS)).astype(np.int64))
        if len(h) <= n + 1:
            out += [np.zeros(0, dtype=np.int64)] * (2 - n)
            break
    return out


def slots(words: list[str]) -> np.ndarray:
    """Slots of the one- to three-word n-grams of a paragraph, each once."""
    return np.unique(np.concatenate(gram_slots(words)))


def _examples() -> tuple[list[np.ndarray], list[int]]:
    """Training and calibration paragraphs made from the templates by a seeded rule."""
    rng, x, y = random.Random(SEED), [], []
    pool = [w for phrases in TEMPLATES.values() for p in phrases for w in p.split()]
    filler = "the of and a to in is for that with on as by this at from it an be are was or".split()
    for k, family in enumerate(FAMILIES[:-1]):
        for phrase in TEMPLATES[family]:
            words = phrase.split()
            for v in range(VARIANTS):
                kept = [w for w in words if v < 4 or len(words) < 6 or rng.random() > 0.12]
                around = [rng.choice(filler) for _ in range(rng.randrange(8))] if v % 2 else []
                cut = rng.randrange(len(around) + 1)
                x.append(slots(around[:cut] + kept + around[cut:]))
                y.append(k)
    for _ in range(VARIANTS * len(FAMILIES) * 2):
        n = rng.randrange(1, 24)
        x.append(slots([rng.choice(pool if rng.random() < 0.4 else filler) for _ in range(n)]))
        y.append(len(FAMILIES) - 1)
        x.append(slots(["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) if rng.random() < 0.7 else rng.choice(filler) for _ in range(n)]))
        y.append(len(FAMILIES) - 1)
    return x, y


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    """Weights (families by slots, the constant last) and the temperature of the probabilities."""
    x, y = _examples()
    held = [i for i in range(len(x)) if i % 5 == 0]
    used = [i for i in range(len(x)) if i % 5]
    dense = np.zeros((len(x), SLOTS + 1), dtype=np.float32)
    for i, s in enumerate(x):
        dense[i, s] = 1 / np.sqrt(max(1, len(s)))
        dense[i, SLOTS] = 1
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    live = np.flatnonzero(dense.any(axis=0))
    a, w = dense[:, live], np.zeros((len(FAMILIES), len(live)), dtype=np.float32)
    for _ in range(STEPS):
        z = a[used] @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 4.0 * ((target[used] - p).T @ a[used] / len(used) - 2e-5 * w)
    z, best = a[held] @ w.T, (np.inf, 1.0)
    for t in np.arange(0.25, 4.01, 0.25):
        q = z / t - (z / t).max(axis=1, keepdims=True)
        loss = -(q - np.log(np.exp(q).sum(axis=1, keepdims=True)))[np.arange(len(held)), np.array(y)[held]].mean()
        best = min(best, (float(loss), float(t)))
    full = np.zeros((len(FAMILIES), SLOTS + 1), dtype=np.float32)
    full[:, live] = w
    return full, best[1]


def probabilities(words: list[str], trained: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    weights, temperature = trained or model()
    s = slots(words)
    z = (weights[:, s].sum(axis=1) / np.sqrt(max(1, len(s))) + weights[:, SLOTS]) / temperature
    p = np.exp(z - z.max())
    return p / p.sum()


def promising(listed: list[list[str]], trained: tuple[np.ndarray, float] | None = None) -> list[bool]:
    """Whether the classifier takes any window of a paragraph's words for a licence rather than for none.

    Windows may begin in one paragraph and end in the next; they count for the first, which only means a look at more.
    """
    weights, temperature = trained or model()
    words = [w for part in listed for w in part]
    if not words:
        return [False] * len(listed)
    # Odds of each family against the unknown class, summed over the n-grams that end at or before each place.
    odds = (weights[:-1] - weights[-1:]).astype(np.float32)
    grams = gram_slots(words)
    hit = np.zeros(len(words), dtype=bool)
    sums = []
    for listed_slots in grams:
        part = np.zeros((len(odds), len(listed_slots) + 1), dtype=np.float64)
        np.cumsum(odds[:, listed_slots], axis=1, out=part[:, 1:])
        sums.append(part)
    for width in WIDTHS:
        width = min(width, len(words))
        n = len(words) - width + 1
        z = np.zeros((len(odds), n))
        count = 0
        for k, part in enumerate(sums):
            if width > k:
                z += part[:, width - k : width - k + n] - part[:, :n]
                count += width - k
        z = (z / np.sqrt(count) + odds[:, SLOTS, None]) / temperature
        hit[:n] |= z.max(axis=0) >= CANDIDATE
    # A window counts for every paragraph that it can reach into.
    ends = np.cumsum([len(part) for part in listed])
    marks = np.concatenate([[0], np.cumsum(hit)])
    begins = ends - [len(part) for part in listed]
    reach = np.maximum(begins - max(WIDTHS) + 1, 0)
    return [bool(len(part) and marks[e] > marks[r]) for part, r, e in zip(listed, reach, ends, strict=True)]


@lru_cache(maxsize=1)
def _template_pairs() -> dict[str, list[tuple[str, set]]]:
    return {
        f: [(" ".join(p.split()), {*zip(p.split(), p.split()[1:], strict=False)}) for p in phrases]
        for f, phrases in TEMPLATES.items()
    }


def agrees(words: list[str], family: str) -> bool:
    """Whether a paragraph holds a short phrase of a family whole, or most pairs of a long one."""
    text, pairs = f" {' '.join(words)} ", {*zip(words, words[1:], strict=False)}
    for phrase, own in _template_pairs()[family]:
        if f" {phrase} " in text:
            return True
        if phrase.count(" ") >= PHRASE_WORDS and len(own & pairs) >= TEMPLATE_SHARE * len(own):
            return True
    return False


@lru_cache(maxsize=1)
def _templates() -> tuple[list[tuple[str, str, dict]], dict]:
    """(family, phrase, {pair: whether no other family has it}) of each template, and the templates of each pair."""
    every = [(f, phrase, own) for f, listed in _template_pairs().items() for phrase, own in listed]
    owners: dict = {}
    for f, _, own in every:
        for pair in own:
            owners.setdefault(pair, set()).add(f)
    all_ = [(f, phrase, {pair: len(owners[pair]) == 1 for pair in own}) for f, phrase, own in every]
    by_pair: dict = {}
    for k, (_, _, own) in enumerate(all_):
        for pair in own:
            by_pair.setdefault(pair, []).append(k)
    return all_, by_pair


def windows(words: list[str]) -> list[tuple[int, int, str]]:
    """(first word, end, family) of the windows of a paragraph that agree with a template."""
    templates, by_pair = _templates()
    text, found = f" {' '.join(words)} ", []
    whole: dict[int, set] = {}
    for family, phrase, _ in templates:
        n, at = phrase.count(" ") + 1, text.find(f" {phrase} ")
        first, counted = 0, 0
        while at >= 0:
            first += text.count(" ", counted, at)
            counted = at
            found.append((first, first + n, family))
            for i in range(first, first + n - 1):
                whole.setdefault(i, set()).add(family)
            at = text.find(f" {phrase} ", at + 1)
    places: dict[int, list[int]] = {}
    taken: dict[int, list[int]] = {}
    for i, pair in enumerate(zip(words, words[1:], strict=False)):
        for k in by_pair.get(pair, ()):
            (places if i not in whole or whole[i] == {templates[k][0]} else taken).setdefault(k, []).append(i)
    for k, listed in places.items():
        family, phrase, own = templates[k]
        least, width = TEMPLATE_SHARE * len(own), SPREAD * (phrase.count(" ") + 1)
        if len(listed) < least:
            continue
        seen, low, best, chosen = Counter(), 0, None, []
        for high, i in enumerate(listed):
            seen[words[i], words[i + 1]] += 1
            while i - listed[low] > width - 2:
                left = words[listed[low]], words[listed[low] + 1]
                seen[left] -= 1
                if not seen[left]:
                    del seen[left]
                low += 1
            if best and listed[low] > best[2]:
                chosen.append(best)
                best = None
            if len(seen) >= least and any(own[x] for x in seen) and (best is None or len(seen) > best[0]):
                best = (len(seen), listed[low], i)
        if best:
            chosen.append(best)
        others = taken.get(k, [])
        for _, a, b in chosen:
            lost = others[bisect_left(others, a) : bisect_right(others, b)]
            if lost:
                own_pairs = {(words[i], words[i + 1]) for i in listed[bisect_left(listed, a) : bisect_right(listed, b)]}
                if any((words[i], words[i + 1]) not in own_pairs for i in lost):
                    continue
            found.append((a, b + 2, family))
    return found


def paragraphs(text: str) -> list[tuple[int, list[str]]]:
    """(number of its first line, lines) of each run of lines that are not blank."""
    out, run = [], []
    for i, line in enumerate(text.split("\n")):
        if line and not line.isspace():
            run.append(line)
        elif run:
            out.append((i - len(run), run))
            run = []
    if run:
        out.append((i + 1 - len(run), run))
    return out


def _places(first: int, parts: list[list[str]], trained: tuple[np.ndarray, float] | None) -> dict[tuple[int, str], float]:
    """Probability of each (line, family) of a paragraph, by the words of its lines."""
    words = [w for part in parts for w in part]
    line_of = [first + i for i, part in enumerate(parts) for _ in part]
    sure, places = [], []
    for a, b, family in {*windows(words)}:
        p = float(probabilities(words[a:b], trained)[FAMILIES.index(family)])
        if p >= MIN_PROBABILITY:
            sure.append((family, a, b, p))
    last: tuple = ("", 0, 0.0, 0)
    for family, a, b, p in sorted(sure):  # overlapping windows of a family are one place, where the most probable begins
        end, best, at = (last[1], last[2], last[3]) if family == last[0] and a < last[1] else (b, -1.0, a)
        if family != last[0] or a >= last[1]:
            places.append(last)
        last = (family, max(end, b), max(best, p), a if p > best else at)
    places.append(last)
    found: dict[tuple[int, str], float] = {}
    for family, _, p, at in places:
        if family:
            key = line_of[at], family
            found[key] = max(found.get(key, 0.0), p)
    return found


def scan_all(texts: list[str], trained: tuple[np.ndarray, float] | None = None) -> Iterator[list[tuple[int, str, float]]]:
    """(line, family, probability) of each place that declares a licence, for each text."""
    waiting: list[list[tuple[int, list[list[str]]]]] = []
    size = 0

    def done() -> Iterator[list[tuple[int, str, float]]]:
        flat = [[w for part in parts for w in part] for listed in waiting for _, parts in listed]
        likely = iter(promising(flat, trained))
        for listed in waiting:
            found: dict[tuple[int, str], float] = {}
            for first, parts in listed:
                if next(likely):
                    found |= _places(first, parts, trained)
            yield [(line, family, p) for (line, family), p in sorted(found.items())]

    for text in texts:
        waiting.append([(first, [line_words(line) for line in lines]) for first, lines in paragraphs(text)])
        size += sum(len(part) for _, parts in waiting[-1] for part in parts)
        if size > STEP_WORDS:
            yield from done()
            waiting, size = [], 0
    yield from done()


def scan(text: str, trained: tuple[np.ndarray, float] | None = None) -> list[tuple[int, str, float]]:
    """(line, family, probability) of each place that declares a licence."""
    return next(scan_all([text], trained))


def license_lines(docs: DataFrame, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with an array of (line, family, probability); the model is trained on the driver and broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf(RESULT)
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series(list(scan_all(texts.tolist(), shared.value)), dtype=object)

    return docs.withColumn(out, scanned(whole_text(text_col)))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its families in order of name, the number of licence lines and the main family."""
    (name,) = fresh(docs, "licenses")
    found = license_lines(docs.select(id_col, text_col), text_col, name)
    best = F.array_sort(F.transform(name, lambda s: F.struct((-s["probability"]).alias("p"), s["family"].alias("family"))))
    return found.select(
        F.col(id_col).alias("doc_id"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda s: s["family"]))), ",").alias("families"),
        F.size(F.array_distinct(F.transform(name, lambda s: s["line"]))).cast("long").alias("n_license_lines"),
        F.coalesce(F.try_element_at(best, F.lit(1))["family"], F.lit(UNKNOWN)).alias("family"),
        F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["line"].cast("string"), s["family"])), ",").alias("lines"),
    )
