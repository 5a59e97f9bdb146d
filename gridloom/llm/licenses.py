"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line and sentence of every text, and every window of words as long as a template,
is a sparse vector over the templates' words (its other words count towards its length
only) and scores its best cosine.  A window may cross lines.  Only what holds an anchor
of a template can reach the threshold and is scored.  Whole texts are scored in the same
way against full license texts, and words in passages of those count as license lines.  Templates are a parameter, so their vectors go with the
task.  A file that is nearly a full license text, or most of whose words lie in license
lines, sentences or windows, is a license file of its directory; files without a license
of their own take that of the nearest directory above them, found by one equi-join of
directories with their ancestors.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def spdx(name: str) -> tuple[str, ...]:
    """SPDX headers of a GNU license."""
    return tuple(f"SPDX-License-Identifier: {name}{end}" for end in ("", "-only", "-or-later"))


def creative_commons(short: str, long: str) -> tuple[str, ...]:
    return (f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"Licensed under CC {short} 4.0.", f"SPDX-License-Identifier: CC-{short}-4.0")


#: License names and the sentences by which files state them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", *spdx("GPL-3.0")),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", *spdx("GPL-2.0")),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", *spdx("LGPL-3.0")),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", *spdx("LGPL-2.1")),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", *spdx("AGPL-3.0")),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": creative_commons("BY", "Attribution"),
    "CC-BY-SA-4.0": creative_commons("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": creative_commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": creative_commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Proprietary": ("All rights reserved. No part may be reproduced without permission.", "All rights reserved."),
}


#: the name of reserved rights: any license stated beside them is likelier
RESERVED = "Proprietary"
#: words that state no license by themselves
STOP = frozenset("the of to in and a is or this for with under it you by be as are any".split())
#: distinct words of the full texts below which a text holds none of them
FEW = 25
SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def full_texts() -> dict[str, tuple[str, ...]]:
    """The full texts of ``license_texts``, by name; read on the driver."""
    return {f.name.removesuffix(".txt"): (f.read_text("utf-8"),) for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")}


def body(text: str) -> str:
    """A text without its lines of copyright, which hold the names of holders."""
    return "\n".join(line for line in text.splitlines() if not line.lower().lstrip(" \t#*/;-").startswith("copyright"))


def shingles(words: list[str], k: int = 5) -> list[int]:
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) for i in range(len(words) - k + 1)]


def variant(name: str, words: frozenset[str]) -> str:
    """The six Creative Commons licenses share most of their text: the conditions named in it tell them apart."""
    if not name.startswith("CC-BY"):
        return name
    return "CC-BY" + "".join(end for word, end in (("noncommercial", "-NC"), ("sharealike", "-SA"), ("noderivatives", "-ND")) if word in words) + "-4.0"


class Templates:
    """Unit TF-IDF vectors of the templates, by word."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        texts = [(name, Counter(WORD.findall(t.lower()))) for name, all_ in sorted(templates.items()) for t in all_]
        df = Counter(w for _, c in texts for w in c)
        self.unseen = math.log(1 + len(texts)) + 1
        self.idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
        self.names = [name for name, _ in texts]
        self.sizes = [sum(c.values()) for _, c in texts]
        #: one word in common ("mit" in German prose) is no statement, nor are common words alone
        self.least = [min(2, len(c)) for _, c in texts]
        self.vectors: list[dict[str, float]] = []
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, (_, counts) in enumerate(texts):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in counts.items()))
            self.vectors.append({w: n * self.idf[w] / norm for w, n in counts.items()})
            for w, y in self.vectors[-1].items():
                self.by_word.setdefault(w, []).append((i, y))

    def anchors(self, threshold: float) -> dict[str, list[int]]:
        """Templates by anchor: what reaches the threshold with a template has one of its anchors.

        By Cauchy and Schwarz the squared weights of the words in common sum to at least
        the squared threshold; words that sum to less are no anchors, the commonest first.
        """
        found: dict[str, list[int]] = {}
        for i, vector in enumerate(self.vectors):
            left = threshold**2 - 1e-9
            for w in sorted(vector, key=lambda w: (w not in STOP, self.idf[w], w)):
                left -= vector[w] ** 2
                if left <= 0:
                    found.setdefault(w, []).append(i)
        return found

    def best(self, words: list[str], anchors: dict[str, list[int]] | None = None) -> tuple[str | None, float]:
        """The likeliest license of a line, of those whose anchors it has, and its cosine; ties go to the first name."""
        counts = Counter(words)
        among = range(len(self.names)) if anchors is None else {i for w in counts if w in anchors for i in anchors[w]}
        scores: dict[int, float] = {}
        for i in among:
            shared = counts.keys() & self.vectors[i].keys()
            if len(shared) >= self.least[i] and not STOP.issuperset(shared):
                # fsum: the order of a set of strings differs between processes
                scores[i] = math.fsum(counts[w] * self.idf[w] * self.vectors[i][w] for w in shared)
        if not scores:
            return None, 0.0
        i = max(scores, key=lambda i: (scores[i], -i))
        return self.names[i], scores[i] / math.sqrt(math.fsum((n * self.idf.get(w, self.unseen)) ** 2 for w, n in counts.items()))

    def windows(self, words: list[str], anchors: dict[str, list[int]], threshold: float) -> Iterator[tuple[str, float, int, int]]:
        """(name, cosine, start, end) of windows as long as a template that reach the threshold with it."""
        near: dict[int, list[int]] = {}
        for p, w in enumerate(words):
            for i in anchors.get(w, ()):
                near.setdefault(i, []).append(p)
        for i, places in sorted(near.items()):
            size, vector, end = min(self.sizes[i], len(words)), self.vectors[i], 0
            for p in places:
                # windows that hold this anchor and were not seen with the one before
                first, last = max(p - size + 1, end, 0), min(p, len(words) - size)
                end = max(end, last + 1)
                if first > last:
                    continue
                around = set(words[first : last + size])
                if sum(y**2 for w, y in vector.items() if w in around) < threshold**2 - 1e-9:
                    continue
                counts = Counter(words[first : first + size])
                for at in range(first, last + 1):
                    if at > first:
                        gone, come = words[at - 1], words[at + size - 1]
                        counts[gone] -= 1
                        if not counts[gone]:
                            del counts[gone]
                        counts[come] += 1
                    shared = [w for w in vector if w in counts]
                    if len(shared) < self.least[i] or STOP.issuperset(shared) or sum(vector[w] ** 2 for w in shared) < threshold**2 - 1e-9:
                        continue
                    dot = sum(counts[w] * self.idf[w] * vector[w] for w in shared)
                    score = dot / math.sqrt(sum((n * self.idf.get(w, self.unseen)) ** 2 for w, n in counts.items()))
                    if score >= threshold:
                        yield self.names[i], score, at, at + size


class Scanner:
    """License, score and whether it is a license file, of one text after the other."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float, file_share: float, texts: dict[str, tuple[str, ...]], file_threshold: float):
        self.model, self.threshold, self.file_share = Templates(templates), threshold, file_share
        self.line_anchors = self.model.anchors(threshold)
        # the best of very many windows has to be nearer than a line or sentence
        self.window_threshold = (1 + threshold) / 2
        self.window_anchors = self.model.anchors(self.window_threshold)
        self.whole, self.file_threshold = Templates({name: tuple(map(body, all_)) for name, all_ in texts.items()}), file_threshold
        self.whole_words = frozenset(self.whole.by_word)
        #: license names by five-word shingle of the full texts
        self.passages: dict[int, set[str]] = {}
        for name, all_ in texts.items():
            for t in all_:
                for x in shingles(WORD.findall(t.lower())):
                    self.passages.setdefault(x, set()).add(name)
        self.shingles = Counter(name for names in self.passages.values() for name in names)

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        words: list[str] = []
        found: list[tuple[str, float, int, int]] = []
        for line in text.splitlines():
            start, of_line = len(words), WORD.findall(line.lower())
            words += of_line
            if self.line_anchors.keys().isdisjoint(of_line):
                continue
            found.append((*self.model.best(of_line, self.line_anchors), start, len(words)))
            sentences = SENTENCE.split(line)
            for sentence in sentences if len(sentences) > 1 else ():
                of_sentence = WORD.findall(sentence.lower())
                found.append((*self.model.best(of_sentence, self.line_anchors), start, start + len(of_sentence)))
                start += len(of_sentence)
        distinct = frozenset(words)
        many = len(distinct & self.whole_words) >= FEW
        if many:
            name, score = self.whole.best(WORD.findall(body(text).lower()))
            if score >= self.file_threshold:
                return variant(name, distinct), score, True
        found = [x for x in found if x[1] >= self.threshold]
        if not distinct.isdisjoint(self.window_anchors):
            found += self.model.windows(words, self.window_anchors, self.window_threshold)
        if not found and not many:
            return None, 0.0, False
        covered = bytearray(len(words))
        for _, _, start, end in found:
            covered[start:end] = b"\1" * (end - start)
        # passages of full texts: files of several licenses, or with words of their own
        seen: set[int] = set()
        for at, x in enumerate(shingles(words)):
            if x in self.passages:
                covered[at : at + 5] = b"\1" * 5
                seen.add(x)
        file = sum(covered) >= self.file_share * len(words)
        if not found:
            votes = Counter(name for x in seen for name in self.passages[x])
            share, name = max(((n / self.shingles[name], name) for name, n in votes.items()), default=(0.0, None))
            return (variant(name, distinct), share, True) if file and share >= self.file_share else (None, 0.0, False)
        name, score, *_ = max(found, key=lambda x: (x[0] != RESERVED, round(x[1], 9), -x[2]))
        return name, score, file


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.5, texts: dict[str, tuple[str, ...]] | None = None, file_threshold: float = 0.9) -> DataFrame:
    """doc_id, path, own_license, own_score and license_file of every row of ``files`` (doc_id, path, text)."""
    scanner = Scanner(templates, threshold, file_share, full_texts() if texts is None else texts, file_threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, files_ = [], [], []
            for item in batch.column(2):
                name, score, file = scanner.scan(item.as_py() or "")
                names.append(name)
                scores.append(round(score, 6))
                files_.append(file)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(files_, pa.bool_())], names=["doc_id", "path", "own_license", "own_score", "license_file"])

    chosen = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, path string, own_license string, own_score double, license_file boolean")


def directory(path: Column) -> Column:
    """The directory of a path, without the closing slash; empty for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """License of every row of ``files`` (doc_id, path, text): its own, or its nearest directory's.

    ``origin`` is ``own``, ``inherited`` or null.  A directory's license is that of its
    license file with the best score, then the smallest path and doc_id.  Cases: null
    and empty texts have no license of their own; a null path inherits nothing;
    repeated rows are scanned each; an empty table gives no rows; further columns are
    ignored.
    """
    # written once: three branches read it, and the texts are scanned in none of them again
    found, _ = materialize(scan(files, templates, threshold, file_share).withColumn("directory", directory(F.col("path"))), "licenses")
    given = (
        found.where("license_file and directory is not null")
        .groupBy("directory")
        .agg(F.min_by(F.struct("own_license", "path"), F.struct(-F.col("own_score"), F.col("path"), F.col("doc_id"), F.col("own_license"))).alias("has"))
        .select(F.col("directory").alias("above"), F.col("has.own_license").alias("above_license"), F.col("has.path").alias("above_path"))
    )
    # directories, not files, meet their ancestors: "a/b" -> "a/b", "a", ""
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ways = found.select("directory").where("directory is not null").distinct().select("directory", F.explode(F.array_distinct(above)).alias("above"))
    nearest = ways.join(given, "above").groupBy("directory").agg(F.max_by(F.struct("above_license", "above_path"), F.length("above")).alias("near")).select("directory", F.col("near.above_license").alias("near_license"), F.col("near.above_path").alias("near_path"))
    own = F.col("own_license").isNotNull()
    return found.join(nearest, "directory", "left").select(
        "doc_id",
        "path",
        F.coalesce("own_license", "near_license").alias("license"),
        F.when(own, "own").when(F.col("near_license").isNotNull(), "inherited").alias("origin"),
        "own_score",
        "license_file",
        F.when(~own, F.col("near_path")).alias("inherited_from"),
    )
