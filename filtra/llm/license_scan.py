"""Licence scan with a positional rare-token index over licence templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import columns_of, new_column, read, words_alnum

#: Phrases whose every place counts for the base labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Notices that the index knows: label, notice, and key phrases that must all stand at their places in it.
TEMPLATES = [
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "this project is released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by", "this work is licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "this work is licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2 of the license"]),
    ("lgpl", "this work is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]

#: Share of a template's inverse-frequency weight that must stand at its places.
LEAST_COVER = 0.5


def _phrase(words: list[bytes], phrase: list[bytes]) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


class LicenceIndex:
    """Templates and base phrases by word and place, with each word's inverse document frequency.

    postings: word -> (entry, place) for the places of an entry that must hold: the
    words of a template's key phrases, all words of a base phrase. A file's licence
    words are looked up by falling idf, so an entry is first met at its rarest word,
    which implies its starts; every further posting is intersected with them by its
    relative place.
    """

    def __init__(self, df: dict[bytes, int], n_docs: int, templates=None, base=None):
        templates = TEMPLATES if templates is None else templates
        self.base = BASE if base is None else base
        self.entries = [(label, words_alnum(p.encode()), None) for label, p in self.base.items()]
        self.n_base = len(self.entries)
        self.entries += [(label, words_alnum(t.encode()), [words_alnum(k.encode()) for k in keys]) for label, t, keys in templates]
        self.vocabulary = {w for _, words, _ in self.entries for w in words}
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 0.5)) for w in self.vocabulary}
        self.rank = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (-self.idf[w], w)))}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.weight, self.need, self.rarest = [], [], []
        for e, (_, words, keys) in enumerate(self.entries):
            self.weight.append(sum(max(self.idf[w], 0.0) for w in words) or 1.0)
            places = {i for k in keys or () for p in _phrase(words, k)[:1] for i in range(p, p + len(k))}
            must = sorted(places or range(len(words)))  # a base phrase must stand whole
            for i in must:
                self.postings.setdefault(words[i], []).append((e, i))
            self.need.append(len(must))
            self.rarest.append(min((words[i] for i in must), key=self.rank.__getitem__, default=b""))

    def starts(self, places: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """entry -> the starts at which all its postings stand, from the places of a file's licence words."""
        alive: dict[int, set[int]] = {}
        met: Counter[int] = Counter()
        for w in sorted(places.keys() & self.postings.keys(), key=self.rank.__getitem__):
            here = places[w]
            at = set(here)
            for e, offset in self.postings[w]:
                if e not in met:
                    if w == self.rarest[e]:  # else a rarer word of it is missing
                        alive[e], met[e] = {p - offset for p in here}, 1
                elif e in alive:
                    left = {s for s in alive[e] if s + offset in at}
                    met[e] += 1
                    if left:
                        alive[e] = left
                    else:
                        del alive[e]
        return {e: sorted(s) for e, s in alive.items() if met[e] == self.need[e]}

    def scan(self, words: list[bytes]) -> dict:
        """Base places, and templates whose key phrases all stand at their relative places."""
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        n, base_at, spans = len(words), [], []
        base_labels, labels, score = set(), set(), 0.0
        for e, starts in self.starts(places).items():
            label, entry, _ = self.entries[e]
            if e < self.n_base:
                base_at += starts
                base_labels.add(label)
                labels.add(label)
                score = 1.0
                continue
            for start in starts:
                covered = sum(max(self.idf[x], 0.0) for i, x in enumerate(entry) if 0 <= start + i < n and words[start + i] == x)
                share = min(1.0, covered / self.weight[e])
                if share >= LEAST_COVER:
                    labels.add(label)
                    score = max(score, share)
                    spans.append((label, max(start, 0), min(start + len(entry), n), share))
        return {
            "n_words": n,
            "n_base": len(base_at),
            "first_word": min(base_at, default=None),
            "last_word": max(base_at, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "spans": [{"label": s[0], "start": s[1], "stop": s[2], "score": s[3]} for s in sorted(spans)],
        }


SCAN = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,"
    "score:double,spans:array<struct<label:string,start:bigint,stop:bigint,score:double>>>"
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])
_SCAN = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
])


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many rows each licence word stands, and the number of rows; only the vocabulary is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                count[b""] += 1
                count.update(vocabulary.intersection(words_alnum(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"].encode(): r["n"] for r in rows.collect()}  # at most one row a licence word
    return df, df.pop(b"", 0)


def scan_licences(docs: DataFrame, text_col: str = "text", out: str = "scan", templates=None, base=None) -> DataFrame:
    """docs with a column `out`: words, base places and labels, all labels, score and matched spans.

    One pass counts in how many documents each licence word stands; a second looks
    up each file's rarest licence words, takes the template starts that they imply,
    intersects them with the other words' places, and keeps templates whose key
    phrases stand whole. No shuffle of texts. Null and empty texts have no words, no
    labels and score 0; repeated rows get the same result each; other columns stay as
    they are, and one called as `out` raises a ValueError. An empty table gives an
    empty one.
    """
    index = LicenceIndex({}, 0, templates, base)
    index = LicenceIndex(*word_frequencies(docs, index.vocabulary, text_col), templates, base)
    wide = docs.select(*columns_of(docs), F.lit(None).cast(SCAN).alias(new_column(docs, out)))
    at, text_at = len(docs.columns), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(words_alnum(t.as_py())) for t in batch.column(text_at).cast(pa.large_binary())]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(found, _SCAN))

    return wide.mapInArrow(run, wide.schema)


def op1_licences(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs).select("doc_id", "scan.*").drop("spans")
