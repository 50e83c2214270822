"""License scans: an exact set-similarity join of license templates and blocks of text.

A template's set is its distinct words; a text's blocks for it are runs of twice its words,
one starting at every multiple of its words, so every run no longer than the template
lies in a block.  A notice longer than its template (with foreign words put in) lies whole in
a block only at some places in its text, up to twice the template's words; elsewhere its
block has only a part of it and may miss the threshold.  A block meets the template if it holds at least ``ceil(threshold *
size)`` of the template's words.  The join:

* one pass counts the words of all templates over all texts; rarest first is the global order;
* prefix filter: a block that meets the template holds one of its ``size - least + 1`` rarest
  words, so only those are looked up;
* length filter: the end of a text may leave a block too short;
* positional filter: a block whose rarest template word stands at place i of the order
  can hold ``size - i`` of them at most;
* what is left is counted exactly.

Base phrases go through the same prefix lookup with threshold 1 and must then stand word
by word in order.  Words are compared as 64-bit hashes of their bytes.

Defined results: null text is empty: no words, no labels, null places, score 0; an empty
table gives an empty result; repeated rows are scanned each; license_scan has a row per
document, license_blocks one per phrase and block found, with its place; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IN_TOKEN, batch_of, chunks, id_and_text, task, word_hashes, word_spans

#: Phrases and labels of the contract.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Notices that the method looks for: label and words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
)

THRESHOLD = 0.9

_COUNTS = pa.schema([("word", pa.int32()), ("n", pa.int64())])
_SCANNED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), IN_TOKEN)
    return word_hashes(data, starts, ends)


class Index:
    """Templates and phrases with their words as places in the sorted vocabulary."""

    def __init__(self, phrases, templates, threshold: float):
        said = [(label, _hashes(text), True) for label, text in phrases] + [(label, _hashes(text), False) for label, text in templates]
        self.vocabulary = np.unique(np.concatenate([h for _, h, _ in said])) if said else np.zeros(0, dtype=np.uint64)
        self.threshold = threshold
        self.entries = [(label, np.searchsorted(self.vocabulary, h), base) for label, h, base in said]
        self.rank = np.arange(len(self.vocabulary))

    def order(self, counts: np.ndarray) -> None:
        """rank: each word's place in the global order, rarest first."""
        self.rank = np.empty(len(counts), dtype=np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, -1 if it has none."""
        if not len(self.vocabulary) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def count_words(docs: DataFrame, index: Index) -> np.ndarray:
    """Occurrences of each vocabulary word in all texts."""
    size = len(index.vocabulary)

    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        for b in batches:
            for _, data, offsets in chunks(b.column("text")):
                starts, ends, _ = word_spans(data, offsets, IN_TOKEN)
                at = index.found(word_hashes(data, starts, ends))
                held += np.bincount(at[at >= 0], minlength=size)
        yield batch_of(_COUNTS, word=np.arange(size, dtype=np.int32), n=held)

    out = np.zeros(size, dtype=np.int64)
    for r in id_and_text(docs).select("text").mapInArrow(task("licenses", run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


_MATCHED = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("is_phrase", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())])


def _blocks(index: Index, words: np.ndarray, first: np.ndarray, hits: np.ndarray, entry: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(text, first word, last word, containment) of blocks that meet the template.  words: vocabulary place of every word; hits: where it is not -1."""
    length, terms = len(entry), np.unique(entry)
    size = len(terms)
    least = max(1, math.ceil(index.threshold * size - 1e-9))
    ordered = terms[np.argsort(index.rank[terms])]
    member = np.zeros(len(index.vocabulary), dtype=bool)
    member[ordered[: size - least + 1]] = True
    rare = hits[member[words[hits]]]  # prefix filter
    if not len(rare):
        return []
    text = np.searchsorted(first, rare, side="right") - 1
    block = (rare - first[text]) // length
    pairs = np.unique(np.concatenate([np.stack([text, block], axis=1), np.stack([text, np.maximum(block - 1, 0)], axis=1)]), axis=0)
    lo = first[pairs[:, 0]] + pairs[:, 1] * length
    hi = np.minimum(lo + 2 * length, first[pairs[:, 0] + 1])
    keep = hi - lo >= least  # length filter
    place = np.full(len(index.vocabulary), size)
    place[ordered] = np.arange(size)
    out = []
    for t, a, z in zip(pairs[keep, 0], lo[keep], hi[keep]):
        own = words[a:z]
        own = place[own[own >= 0]]
        own = own[own < size]
        if not len(own) or size - own.min() < least:  # positional filter
            continue
        held = len(np.unique(own))
        if held >= least:
            out.append((int(t), int(a - first[t]), int(z - first[t]) - 1, held / size))
    return out


def _places(index: Index, words: np.ndarray, first: np.ndarray, hits: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and starts (words from the text's first) where the phrase's words stand consecutively."""
    j = int(np.argmin(index.rank[entry]))  # with threshold 1 the prefix is the rarest word
    start = hits[words[hits] == entry[j]] - j
    start = start[(start >= 0) & (start + len(entry) <= len(words))]
    for k, w in enumerate(entry):
        start = start[words[start + k] == w]
    text = np.searchsorted(first, start, side="right") - 1
    whole = start + len(entry) <= first[text + 1]
    text, start = text[whole], start[whole]
    return text, start - first[text]


def _scan(index: Index, batches):
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for at, data, offsets in chunks(b.column("text")):
            starts, ends, first = word_spans(data, offsets, IN_TOKEN)
            words = index.found(word_hashes(data, starts, ends))
            hits = np.flatnonzero(words >= 0)
            n = len(offsets) - 1
            n_base, lowest, highest = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            more: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)
            for label, entry, is_phrase in index.entries:
                if is_phrase:
                    text, start = _places(index, words, first, hits, entry)
                    np.add.at(n_base, text, 1)
                    np.minimum.at(lowest, text, start)
                    np.maximum.at(highest, text, start)
                    score[text] = 1.0
                    for t in np.unique(text):
                        base[t].add(label)
                else:
                    for t, _, _, c in _blocks(index, words, first, hits, entry):
                        more[t].add(label)
                        score[t] = max(score[t], c)
            yield batch_of(
                _SCANNED,
                doc_id=ids[at : at + n],
                n_words=np.diff(first),
                n_base=n_base,
                first_word=pa.array(lowest, mask=n_base == 0),
                last_word=pa.array(highest, mask=n_base == 0),
                base_labels=[",".join(sorted(x)) for x in base],
                labels=[",".join(sorted(x | y)) for x, y in zip(base, more)],
                score=score,
            )


def _scan_blocks(index: Index, batches):
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for at, data, offsets in chunks(b.column("text")):
            starts, ends, first = word_spans(data, offsets, IN_TOKEN)
            words = index.found(word_hashes(data, starts, ends))
            hits = np.flatnonzero(words >= 0)
            for label, entry, is_phrase in index.entries:
                if is_phrase:
                    found = [(int(t), int(s), int(s) + len(entry) - 1, 1.0) for t, s in zip(*_places(index, words, first, hits, entry))]
                else:
                    found = _blocks(index, words, first, hits, entry)
                if found:
                    texts, lo, hi, held = zip(*found)
                    yield batch_of(_MATCHED, doc_id=[ids[at + t] for t in texts], label=[label] * len(texts), is_phrase=[is_phrase] * len(texts), first_word=lo, last_word=hi, containment=held)


def license_blocks(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every phrase and every block that meets a template: doc_id, label, is_phrase, first_word, last_word (from 0), containment."""
    index = Index(phrases, templates, threshold)
    index.order(count_words(docs, index))
    sent = docs.sparkSession.sparkContext.broadcast(index)
    return id_and_text(docs).mapInArrow(task("licenses", lambda batches: _scan_blocks(sent.value, batches)), "doc_id long, label string, is_phrase boolean, first_word long, last_word long, containment double")


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    index = Index(phrases, templates, threshold)
    index.order(count_words(docs, index))
    sent = docs.sparkSession.sparkContext.broadcast(index)
    return id_and_text(docs).mapInArrow(task("licenses", lambda batches: _scan(sent.value, batches)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
