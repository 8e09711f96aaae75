"""Licence notices in texts (operator 7).

Templates are cut into word n-grams; winnowing picks the least hash of every window as fingerprints, and an inverted
index leads from a fingerprint to its places in the templates. All n-grams of a text are looked up. Places on
nearby diagonals are one candidate, which a sequence alignment in a band around the diagonal confirms: it
reports the share of the template's words that match and the span from the first to the last of them. The
index holds the templates alone, whose number the caller bounds; the scan is row-local.

Null and empty texts have no matches. Texts are scanned whole. Repeated rows and notices each give rows; of overlapping candidates of
a template the one with most matches stays. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.rows import text_of
from holdfast.storage import spread

# Notices as their licences word them.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                "the following conditions are met",
}
WORD = re.compile(r"\w+")


class Index:
    def __init__(self, templates: dict[str, str], gram: int, window: int):
        self.words = {k: [w.lower() for w in WORD.findall(t)] for k, t in sorted(templates.items())}
        self.gram = gram
        self.places: dict[tuple, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            grams = [tuple(words[i:i + gram]) for i in range(len(words) - gram + 1)]
            hashes = [crc32(" ".join(g).encode()) for g in grams]
            chosen = {min(range(i, min(i + window, len(grams))), key=lambda j: (hashes[j], -j))
                      for i in range(max(1, len(grams) - window + 1))} if grams else set()
            for i in chosen:
                self.places[grams[i]].append((name, i))
        self.first = {g[0] for g in self.places}

    def candidates(self, words: list[str], band: int) -> dict[tuple[str, int], None]:
        """(template, diagonal), one for each run of diagonals within the band."""
        found = defaultdict(set)
        for i, word in enumerate(words):
            if word in self.first:
                for name, j in self.places.get(tuple(words[i:i + self.gram]), ()):
                    found[name].add(i - j)
        out = {}
        for name, diagonals in found.items():
            last = None
            for d in sorted(diagonals):
                if last is None or d - last > band:
                    out[name, d] = None
                    last = d
        return out


def align(template: list[str], words: list[str], diagonal: int, band: int) -> tuple[int, int, int]:
    """Matched template words, and the first and last matched place in ``words``, along the band.

    A longest common subsequence whose path stays within ``band`` of the diagonal; of equally long ones the shortest span.
    """
    width = 2 * band + 1
    # For each offset in the band: (matches, first place, minus the last place); greater is better.
    row = [(0, 0, 0)] * width
    for j, word in enumerate(template):
        new, before = [], (0, 0, 0)
        for b in range(width):
            i = j + diagonal + b - band
            best = max(before, row[b + 1] if b + 1 < width else (0, 0, 0))
            if 0 <= i < len(words) and words[i] == word:
                n, first, _ = row[b]
                best = max(best, (n + 1, first if n else i, -i))
            new.append(best)
            before = best
        row = new
    n, first, last = max(row)
    return n, first, -last


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, gram: int = 3, window: int = 4,
         band: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per notice found: doc_id, licence, start and end (code points), matched words, coverage."""
    index = Index(TEMPLATES if templates is None else templates, gram, window)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = WORD.findall(text.lower())
                near = index.candidates(words, band)
                if not near:
                    continue
                # Places by the words of the text itself: lower case can be longer.
                spans = [m.span() for m in WORD.finditer(text)]
                words = [text[a:b].lower() for a, b in spans]
                kept: dict[str, list] = defaultdict(list)
                for name, diagonal in index.candidates(words, band):
                    n, first, last = align(index.words[name], words, diagonal, band)
                    if n >= coverage * len(index.words[name]):
                        kept[name].append((n, first, last))
                for name, hits in kept.items():
                    done: list[tuple[int, int]] = []
                    for n, first, last in sorted(hits, key=lambda h: (-h[0], h[2] - h[1], h[1])):
                        if all(last < a or first > b for a, b in done):
                            done.append((first, last))
                            out.append((doc, name, spans[first][0], spans[last][1], n, n / len(index.words[name])))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["doc_id", "licence", "start", "end", "matched", "coverage"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(find, f"doc_id {kind}, licence string, start long, end long, matched long, coverage double")
