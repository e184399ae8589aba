"""Licence scans with a positional index of rare words.

Every template (a phrase or a licence passage) is indexed by its highest-IDF words with their places in it; IDF is
counted over all documents. In a document, each of those words votes for (template, place where it would begin);
phrases need their one rarest word, passages ``VOTES`` of their anchors at the same beginning. Candidates are
verified: a phrase word for word, a passage by the share of its words that stand at their places and by its
mandatory key phrases. A phrase that stands in a document holds its anchor there, so none is missed.

Scale: two passes over the texts without a shuffle of rows: word counts (one row per template word and task, summed)
and the scan. The index is built from the templates, so its size does not depend on the corpus.

Cases: a null or empty text has no words and no label, score 0; overlapping places all count; repeated rows are
scanned alike; words are split at ASCII signs other than letters and digits, so ``MIT-License`` is a place of
``mit license``; null ids and extra columns of ``docs`` are kept or ignored as selected; an empty table gives an
empty result (every template word is then equally rare).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.llm.common import whole

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label: (passage, mandatory key phrases); words as the scan cuts them
PASSAGES = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
         ["apache license", "version 2 0", "in compliance with the license"]),
    ],
    "gpl-3.0": [
        ("this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
         "as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ],
    "gpl-2.0": [
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
         "as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
         "files the software to deal in the software without restriction", ["permission is hereby granted", "without restriction"]),
    ],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
         "conditions are met", ["redistribution and use", "source and binary forms"]),
    ],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc 4 0"])],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa 4 0"])],
    "cc-by-4.0": [("licensed under cc by 4 0", ["cc by 4 0"])],
    "mpl-2.0": [
        ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ],
}
ANCHORS, VOTES, COVER = 4, 2, 0.8

_CUT = bytes(
    c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256)
)


def cut_words(text: str) -> list[bytes]:
    """Lower-case words of ASCII letters and digits and of all other signs."""
    return text.encode().translate(_CUT).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrase: bool
    keys: list[tuple[int, list[bytes]]] = field(default_factory=list)  # place in the template, words


def _templates() -> list[Template]:
    out = [Template(label, cut_words(p), True) for p, label in PHRASES.items()]
    for label, passages in PASSAGES.items():
        for passage, keys in passages:
            words, places = cut_words(passage), []
            for key in map(cut_words, keys):
                places.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
            out.append(Template(label, words, False, places))
    return out


TEMPLATES = _templates()
VOCABULARY = frozenset(w for t in TEMPLATES for w in t.words)


def document_counts(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each template word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(VOCABULARY.intersection(cut_words(text)))
        seen[b""] = n
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select(whole(text).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in rows.collect()}  # one row per template word at most
    return found.pop(b"", 0), found


class Index:
    """Postings of each template's rarest words."""

    def __init__(self, n_docs: int, holding: dict[bytes, int]):
        self.idf = {w: math.log((n_docs + 1) / (holding.get(w, 0) + 1)) for w in VOCABULARY}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: list[int] = []
        for k, t in enumerate(TEMPLATES):
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[: 1 if t.phrase else ANCHORS]
            self.anchors.append(len(rare))
            for word in rare:
                # a phrase's rarest word at its first place is enough; a passage's votes with all its places
                places = [i for i, w in enumerate(t.words) if w == word]
                self.postings[word] += [(k, i) for i in (places[:1] if t.phrase else places)]
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of base phrases as (start, label), and the share of the best passage by label."""
        places: list[tuple[int, str]] = []
        best: dict[str, float] = {}
        if self.rare.isdisjoint(words):
            return places, best
        votes: Counter = Counter()
        for i, word in enumerate(words):
            if word in self.rare:
                votes.update((k, i - at) for k, at in self.postings[word])
        for (k, start), n in votes.items():
            t = TEMPLATES[k]
            if t.phrase:
                if start >= 0 and words[start : start + len(t.words)] == t.words:
                    places.append((start, t.label))
                continue
            if n < min(VOTES, self.anchors[k]):
                continue
            if any(start + at < 0 or words[start + at : start + at + len(key)] != key for at, key in t.keys):
                continue
            met = sum(0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(t.words)) / len(t.words)
            if met >= COVER:
                best[t.label] = max(met, best.get(t.label, 0.0))
        return places, best


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    ``score`` is the share of the best verified template's words at their places (1 for a whole phrase)."""
    index = Index(*document_counts(docs, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for text in batch.column(1).to_pylist():
                words = cut_words(text)
                places, best = index.scan(words)
                starts = [s for s, _ in places]
                base = {label for _, label in places}
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | set(best))))
                out["score"].append(1.0 if base else max(best.values(), default=0.0))
            arrays = [pa.array(v, pa.string() if "labels" in n else pa.float64() if n == "score" else pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *out])

    rows = docs.select(F.col(key), whole(text).alias("_text"))
    schema = rows.drop("_text").schema
    for name in ("n_words", "n_base", "first_word", "last_word"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(scan, schema.add("base_labels", "string").add("labels", "string").add("score", "double"))
