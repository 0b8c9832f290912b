"""Licence scans: a trained paragraph classifier, confirmed by the licences' names.

Paragraphs are lines, confirmed within their block (up to a blank line), as notices are wrapped. A multinomial logistic regression over sparse word n-grams (words and pairs of
words of the training paragraphs) gives each paragraph the chances of the licence families and of
``none``. It is trained here, on the driver, on paragraphs made from the templates below and on a
bounded sample of corpus paragraphs as ``none`` (``max_negatives``). Chances are calibrated on held-out
paragraphs, from mixtures of templates that belong to no family as well: a temperature, and the chance
below which a paragraph that is no ``none`` is ``unknown``. A family stands if and only if the words that tell it from
others begin in the paragraph: its name with all qualifiers (``Lesser``, ``NC``), or the fixed opening
of its text. Qualifiers of no family here (Affero, NC-SA, ND) make the paragraph ``unknown``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions.shipping import ship
from quillguard.llm.common import small_batches, work_dir, written

MAX_NEGATIVES = 2_000
MAX_NEGATIVE_CHARS = 4_000
UNKNOWN, NONE = "unknown", "none"

# Short forms in which licences are commonly named.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "you may not use this file except in compliance with the apache license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "released under the gnu general public license version 2", "this program is free software you can redistribute it under the terms of the gnu general public license", "licensed under the gpl"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "released under the gnu lesser general public license", "licensed under the lgpl"],
    "bsd": ["licensed under the bsd 3 clause license", "released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted"],
    "mpl": ["licensed under the mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["released under cc0 1 0", "dedicated to the public domain under cc0 1 0 universal"],
    "reserved": ["all rights reserved", "copyright 2020 all rights reserved", "all rights are reserved by the author"],
}
_FRAMES = ("{}", "{}", "copyright 2021 {}", "note {}", "{} see the file for details", "the text is {}", "unless noted {}", "{} by the authors")
# Wordings about licences of no family above.
_STRANGE = ("licensed under the house license version 7", "released under a custom license of the company", "subject to the terms of the seller license agreement", "this license grants use to members of the club", "licensed for evaluation use under the vendor license terms")
# What a licence's name follows, with a few words between.
_CUE = r"(?:licen[sc]e[sd]?|licensing|released|distributed|available|covered|governed|published|redistribute|under|terms|identifier)"
_LICENSE = r"licen[sc]e"
_AFTER = rf"\b{_CUE}(?: \w+){{0,4}}? "
_QUALIFIER = r"nc|sa|nd|non ?commercial|share ?alike|no ?deriv(?:ative)?s?(?: works)?"
_CC = rf"(?:cc by|creative commons attribution)(?P<cc>(?: (?:{_QUALIFIER}))*)\b"
# Names in the words of a block; the first that fits at a place counts. ``unknown``: none of the families.
_NAMES = (
    ("unknown", rf"\b(?:gnu )?affero general public {_LICENSE}|\bagplv?\b|\bmit (?:0|no attribution)\b"),
    ("lgpl", rf"\b(?:lesser|library) (?:gnu )?general public {_LICENSE}|{_AFTER}(?:gnu )?lgplv?\b|\blgplv? (?:version )?\d"),
    ("gpl", rf"(?<!affero )(?<!lesser )(?<!library )\bgeneral public {_LICENSE}|{_AFTER}(?:gnu )?gplv?\b|\bgplv? (?:version )?\d|\bgpl {_LICENSE}"),
    ("mit", rf"\b(?:mit|expat) (?:x11 )?(?:style )?{_LICENSE}|\b(?:under|identifier|licensed) (?:the )?(?:terms of (?:the )?)?mit\b(?! (?:0|no attribution)\b)|\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b"),
    ("apache", rf"\bapache (?:software )?{_LICENSE}|{_AFTER}apache (?:v |version )?[12]\b"),
    ("bsd", rf"\bbsd (?:\w+ ){{0,2}}?{_LICENSE}|{_AFTER}(?:\d clause )?bsd\b|\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("mpl", rf"\bmozilla public {_LICENSE}|{_AFTER}mplv?\b"),
    ("cc", rf"\b{_CC}"),
    ("cc0", r"\bcc 0\b|\bcreative commons zero\b"),
    ("reserved", r"\ball rights (?:are )?reserved\b"),
)
_NAME = [(f, re.compile(p)) for f, p in _NAMES]
_NAMED = re.compile(r"licen[sc]|rights|permission|redistribution|gpl|mpl|creative|\bcc|released|distributed|available|covered|governed|published|under|terms|identifier", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


@dataclass
class Model:
    families: list[str]  # with NONE at last
    vocabulary: dict[str, int]  # words and pairs of words
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def rows(self, paragraphs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: feature, value and the number of features of each paragraph."""
        get = self.vocabulary.get
        feature, size = [], []
        for words in paragraphs:
            found = {get(w) for w in words} | {get(f"{a} {b}") for a, b in zip(words, words[1:])}
            found.discard(None)
            feature += sorted(found)
            size.append(len(found))
        sizes = np.array(size, np.int64)
        lengths = np.array([2 * len(w) - 1 for w in paragraphs], np.float64)
        return np.array(feature, np.int64), np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), sizes), sizes

    def logits(self, paragraphs: list[list[str]]) -> np.ndarray:
        feature, value, sizes = self.rows(paragraphs)
        parts = np.concatenate([np.zeros((1, len(self.families))), np.cumsum(self.weights[feature] * value[:, None], axis=0)])
        ends = np.cumsum(sizes)
        return parts[ends] - parts[ends - sizes] + self.bias

    def chances(self, paragraphs: list[list[str]]) -> np.ndarray:
        return _softmax(self.logits(paragraphs) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Fit on templates in their frames and on ``negatives``; every fifth paragraph is held out."""
    families = [*TEMPLATES, NONE]
    made = [(words_of(frame.format(t)), families.index(f)) for f, ts in TEMPLATES.items() for t in ts for frame in _FRAMES]
    made += [(words_of(n), len(families) - 1) for n in negatives]
    made = [(w, y) for w, y in made if w]
    fit = [m for i, m in enumerate(made) if i % 5]
    held = [m for i, m in enumerate(made) if not i % 5]
    none = len(families) - 1
    often = Counter(g for w, y in fit if y == none for g in set(w))
    grams = dict.fromkeys(g for w, y in fit if y < none for g in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))))
    grams.update(dict.fromkeys(g for g, n in often.items() if n >= 5))
    model = Model(families, {g: i for i, g in enumerate(grams)}, np.zeros((len(grams), len(families))), np.zeros(len(families)))
    feature, value, sizes = model.rows([w for w, _ in fit])
    row = np.repeat(np.arange(len(fit)), sizes)
    order = np.argsort(feature, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(feature[order]) > 0])
    seen = feature[order][heads]
    held_rows = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[held_rows]
    truth = np.eye(len(families))[[y for _, y in fit]]
    share = truth.sum(axis=0)
    weight = (len(fit) / (len(families) * np.maximum(share, 1)))[truth.argmax(axis=1)][:, None]
    for _ in range(rounds):
        scores = np.zeros_like(truth)
        scores[held_rows] = np.add.reduceat(model.weights[feature] * value[:, None], starts)
        error = (_softmax(scores + model.bias) - truth) * weight / len(fit)
        step = decay * model.weights
        step[seen] += np.add.reduceat((error[row] * value[:, None])[order], heads)
        model.weights -= rate * len(families) * step
        model.bias -= rate * error.sum(axis=0)
    _calibrate(model, held)
    return model


def _calibrate(model: Model, held: list[tuple[list[str], int]]) -> None:
    """The temperature of least held-out loss, and the chance that parts known families from strange
    wordings best."""
    logits, truth = model.logits([w for w, _ in held]), np.array([y for _, y in held])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
    none = len(model.families) - 1
    known = model.chances([w for w, y in held if y != none])[:, :none].max(axis=1)
    strange = model.chances([words_of(f.format(s)) for s in _STRANGE for f in _FRAMES])[:, :none].max(axis=1)
    model.least = max((i / 100 for i in range(10, 96)), key=lambda t: (known >= t).mean() + (strange < t).mean())


def _cc_family(qualifiers: str) -> str:
    plain = qualifiers.replace(" ", "").replace("noncommercial", "nc").replace("sharealike", "sa")
    return {"": "cc-by", "nc": "cc-by-nc", "sa": "cc-by-sa"}.get(plain, UNKNOWN)


def named(lines: list[list[str]]) -> list[set[str]]:
    """Families (or ``unknown``) whose names begin in each line of a block of lines."""
    out: list[set[str]] = [set() for _ in lines]
    texts = [" ".join(w) for w in lines]
    block = " ".join(t for t in texts if t)
    line_of = np.cumsum([len(t) + 1 if t else 0 for t in texts])
    for family, pattern in _NAME:
        for m in pattern.finditer(block):
            # of a name that follows a cue, the line of the cue
            at = int(np.searchsorted(line_of, m.start(), "right"))
            out[at].add(_cc_family(m["cc"]) if family == "cc" else family)
    return out


def blocks(text: str | None) -> list[list[str]]:
    """The lines of a text that are not blank, by block."""
    out: list[list[str]] = [[]]
    for line in (text or "").split("\n"):
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def classify(model: Model, parts: list[list[str]]) -> list[tuple[list[str], float]]:
    """Families of each line of the blocks, among them ``unknown``, or ``none`` alone, and the least chance."""
    split = [words_of(p) for lines in parts for p in lines]
    chances = model.chances(split) if split else np.zeros((0, len(model.families)))
    known = model.rows(split)[2]  # a paragraph without any n-gram of the training is none
    names: list[set[str]] = []
    for lines in parts:
        found = any(_NAMED.search(p) for p in lines)
        names += named(split[len(names) : len(names) + len(lines)]) if found else [set()] * len(lines)
    out = []
    for chance, n, own in zip(chances, known.tolist(), names):
        best = int(chance[:-1].argmax())
        if own:
            out.append((sorted(own), min(float(chance[best if f == UNKNOWN else model.families.index(f)]) for f in own)))
        elif not n or chance[-1] >= chance[best]:
            out.append(([NONE], float(chance[-1])))
        else:
            out.append(([UNKNOWN], float(chance[best])))
    return out


def _sampled(docs: DataFrame, most: int) -> list[str]:
    """Corpus paragraphs for ``none``: at most ``most`` texts, chosen by hash, one paragraph each. The
    range of hashes follows the row count, so that tasks send no more than is used."""
    share = min(1.0, 4 * most / max(1, docs.count()))
    one = F.element_at(F.split(F.substring("text", 1, MAX_NEGATIVE_CHARS), "\n"), 1)
    rows = docs.filter("length(text) > 0").select(one.alias("p"), F.xxhash64("text").alias("h")).filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h").limit(most).collect()
    named = re.compile("licen[sc]e|copyright|rights|public domain", re.I)
    return [r.p for r in rows if not named.search(r.p)]


def license_scan(docs: DataFrame, max_negatives: int = MAX_NEGATIVES) -> DataFrame:
    """doc_id, n_paragraphs, n_license, families (sorted, comma-joined) and chance (of the least
    certain licence paragraph) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``unknown`` stands among the families for paragraphs on licences that no name confirms. A notice wrapped
    over lines counts for the line in which its name begins. Null and
    empty texts have no paragraphs; blank lines are none. Equal rows are scanned each. An empty table
    gives no rows; the model then knows templates only.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(_sampled(docs, max_negatives)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            parts, of, counts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = blocks(text)
                parts += own
                counts.append(sum(map(len, own)))
                of += [i] * counts[-1]
            found: list[list[tuple[list[str], float]]] = [[] for _ in counts]
            for i, (families, chance) in zip(of, classify(model, parts)):
                if families != [NONE]:
                    found[i].append((families, chance))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({x for xs, _ in f for x in xs})) for f in found]),
                    pa.array([min((round(c, 4) for _, c in f), default=None) for f in found], pa.float64()),
                ],
                ["doc_id", "n_paragraphs", "n_license", "families", "chance"],
            )

    scanned = docs.select(F.col("doc_id").cast("long"), "text")
    return scanned.mapInArrow(run, "doc_id long, n_paragraphs long, n_license long, families string, chance double")
