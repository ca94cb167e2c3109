"""License scans by a generalised suffix automaton over license words.

All template texts and phrases, as words, build one suffix automaton: its states
are the classes of word sequences that end at the same places.  A file's words
are streamed through it once; the state and the length of the current match are
the matching statistics (the longest sequence of template words that ends
here).  From them come

* phrases: a phrase stands where the state lies below the phrase's own state in
  the tree of suffix links and the match is at least as long;
* spans: matches of ``MIN_MATCH`` words or more that can't be extended are
  placed in their templates and chained, in the order of both file and template
  and with gaps up to ``GAP`` words; a chain that covers ``COVER`` of the words
  between its first and last template place, and ``SHARE`` of the template, gives
  the template's label.

Words are runs of letters and digits of ASCII, lower-cased, and of all other
characters.  Words that no template has reset the match, so most of a text costs
one lookup a word.

Scale: one narrow pass; the automaton's size is bounded by the templates, which
the caller states; memory is that of one text.

Defined cases: null and empty texts have no words and no labels; overlapping
phrases all count; repeated rows are judged alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import id_and_text

MIN_MATCH, GAP, COVER, SHARE = 5, 8, 0.7, 0.5

# Phrases and the labels they give.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Short notices of public licenses and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
]

#: Lower-cases A-Z and turns other ASCII that isn't a letter or digit into a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class SuffixAutomaton:
    """Of several word sequences; states are numbers, 0 the empty match."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Where a state's sequences end: (sequence, end).
        self.ends: list[list[tuple[int, int]]] = [[]]
        for n, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].append((n, i + 1))
        self.vocabulary = frozenset(w for s in sequences for w in s)
        # Ends pass up the links, from long to short.
        for s in sorted(range(1, len(self.link)), key=lambda x: -self.length[x]):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        self.ends = [sorted(set(x)) for x in self.ends]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state of exactly length[p] + 1, cloned out of q where q is longer."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def walk(self, seq: list[bytes]) -> int:
        s = 0
        for w in seq:
            s = self.next[s][w]
        return s


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        self.templates = [(label, words(t.encode())) for label, t in templates]
        self.phrases = [(label, words(p.encode())) for p, label in phrases]
        self.auto = SuffixAutomaton([t for _, t in self.templates] + [p for _, p in self.phrases])
        own = [self.auto.walk(p) for _, p in self.phrases]
        #: Phrases that end wherever a state's longer sequences end, with their lengths.
        self.at: list[list[tuple[int, int]]] = [[] for _ in self.auto.link]
        for s in sorted(range(len(self.auto.link)), key=lambda x: self.auto.length[x]):
            up = self.at[self.auto.link[s]] if s else []
            self.at[s] = up + [(n, len(p)) for n, (_, p) in enumerate(self.phrases) if own[n] == s]

    def scan(self, text: bytes) -> dict:
        found = words(text)
        auto, vocabulary = self.auto, self.auto.vocabulary
        moves, link, length, phrase_at = auto.next, auto.link, auto.length, self.at
        hits: list[tuple[int, int]] = []  # (start, phrase)
        long: list[tuple[int, int, int]] = []  # (end in the file, length, state)
        s = n = 0
        before = -1
        for i in [i for i, w in enumerate(found) if w in vocabulary]:
            if i != before + 1:
                if n >= MIN_MATCH:
                    long.append((before + 1, n, s))
                s = n = 0
            before = i
            w = found[i]
            if w not in moves[s]:
                if n >= MIN_MATCH:
                    long.append((i, n, s))
                while s and w not in moves[s]:
                    s = link[s]
                    n = length[s]
            s = moves[s][w]
            n += 1
            if phrase_at[s]:
                hits.extend((i - m + 1, p) for p, m in phrase_at[s] if m <= n)
        if n >= MIN_MATCH:
            long.append((before + 1, n, s))
        spans = self._spans(long)
        return {"n_words": len(found), "hits": sorted(hits), "spans": spans}

    def _spans(self, long: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of templates that chains cover."""
        by: dict[int, list[tuple[int, int, int]]] = {}  # template: (file start, template start, length)
        for end, n, s in long:
            for t, at in self.auto.ends[s]:
                if t < len(self.templates):
                    by.setdefault(t, []).append((end - n, at - n, n))
        out = []
        for t, matches in by.items():
            label, size = self.templates[t][0], len(self.templates[t][1])
            best: list[tuple[int, int, int, int]] = []  # covered words, file start, template start, file end
            for k, (a, b, n) in enumerate(matches):
                mine = (n, a, b, a + n)
                for j in range(k - 1, -1, -1):
                    x, y, m = matches[j]
                    if x + m < a - GAP:  # matches come in the order of their ends: all before are too far off
                        break
                    # A match may overlap the one before by a word or two: only what is new counts.
                    over = max(0, x + m - a, y + m - b)
                    if x < a and y < b and over < n and a - (x + m) <= GAP and b - (y + m) <= GAP and best[j][0] + n - over > mine[0]:
                        mine = (best[j][0] + n - over, best[j][1], best[j][2], a + n)
                best.append(mine)
            for k, (covered, a, b, end) in enumerate(best):
                reach = matches[k][1] + matches[k][2] - b
                if covered >= SHARE * size and covered >= COVER * reach:
                    out.append((label, a, end, min(1.0, covered / size)))
        # Of overlapping spans of one label the fullest. Those kept are disjoint, so one neighbour tells.
        kept: dict[str, list[tuple[int, int, float]]] = {}
        for label, first, end, share in sorted(out, key=lambda x: (-x[3], x[1], -x[2], x[0])):
            own = kept.setdefault(label, [])
            at = bisect_left(own, (end,))
            if not at or own[at - 1][1] <= first:
                own.insert(at, (first, end, share))
        return sorted(((label, *x) for label, own in kept.items() for x in own), key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, phrases (start, label), spans (label, first, end, share)."""
    rows = id_and_text(docs, id_col, text_col)
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            got = [scanner.scan(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x["n_words"] for x in got], pa.int64()),
                    pa.array([[{"start": a, "label": phrases[p][1]} for a, p in x["hits"]] for x in got], kinds[0]),
                    pa.array([[dict(zip(("label", "first", "end", "share"), y, strict=True)) for y in x["spans"]] for x in got], kinds[1]),
                ],
                ["doc_id", "n_words", "phrases", "spans"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, phrases array<struct<start:long,label:string>>, spans array<struct<label:string,first:long,end:long,share:double>>")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 with a phrase, else the best span's share."""
    found = scan(docs)
    starts = F.transform("phrases", lambda x: x["start"])
    labels = F.transform("phrases", lambda x: x["label"])
    spans = F.transform("spans", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, spans)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
