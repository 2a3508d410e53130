"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance by directory.

A file's header is its line that is most like a template; a license file is one that is like a template
as a whole.  Weights come from how many documents hold each template word, counted over all of them; a
word that no template has weighs like one of a single document.  A file without a license of its own
has that of the nearest directory above it, its own directory first, that holds a license file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmtrace.llm.common import batches, factorised, materialise, own as free, slices

# Notices in common use and the short names of their licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# A line with none of these stems is like no template.
STEMS = "licen[cs]e|permission|permitted|redistribut|public domain"
MARKS = " .,;:!?\"'()[]{}<>|*#&$%-_/\\"
OWN = "path string, text_hash bigint, license string, score double, found string, line int"


def words(text: str) -> list[str]:
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w]


class Scorer:
    """TF-IDF vectors of the templates, and the most similar one of a text."""

    def __init__(self, templates, documents: int, holding: dict[str, int]):
        self.rare = log(1 + documents)
        self.weight = {w: log((1 + documents) / (1 + n)) + 1e-3 for w, n in holding.items()}
        self.templates = []
        for name, text in templates:
            vector = {w: n * self.weight.get(w, self.rare) for w, n in Counter(words(text)).items()}
            self.templates.append((name, vector, sqrt(sum(x * x for x in vector.values()))))

    def best(self, text: str) -> tuple[float, str | None]:
        """The highest cosine and its license; of equal ones the first template's."""
        vector = {w: n * self.weight.get(w, self.rare) for w, n in Counter(words(text)).items()}
        length = sqrt(sum(x * x for x in vector.values()))
        found: tuple[float, str | None] = (0.0, None)
        for name, other, size in self.templates:
            dot = sum(x * vector[w] for w, x in other.items() if w in vector)
            if dot > found[0] * length * size * (1 + 1e-12):
                found = dot / (length * size), name
        return found


def holding(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How many of all documents hold each word of ``vocabulary``."""
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in source:
            for some in slices(batch):
                first, codes, seen = factorised(some["text"])
                bare = pc.utf8_trim(seen, characters=MARKS)
                number = pc.index_in(bare, pa.array(sorted(vocabulary))).to_numpy(zero_copy_only=False)
                known = np.nan_to_num(number, nan=-1).astype(np.int64)[codes]
                text = np.repeat(np.arange(len(some)), np.diff(first))
                there = np.unique((text * len(vocabulary) + known)[known >= 0]) % len(vocabulary)
                total.update(dict(enumerate(np.bincount(there, minlength=len(vocabulary)).tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    names = sorted(vocabulary)
    rows = docs.select("text").mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {names[r["word"]]: r["n"] for r in rows}


def own_licenses(files: DataFrame, templates, least_header: float, least_file: float) -> DataFrame:
    """path, text_hash, license, score, found, line: files with a license of their own."""
    vocabulary = {w for _, text in templates for w in words(text)}
    scorer = Scorer(templates, files.count(), holding(files, vocabulary))
    schema = pa.schema([("path", pa.string()), ("text_hash", pa.int64()), ("license", pa.string()), ("score", pa.float64()),
                        ("found", pa.string()), ("line", pa.int32())])
    stems = re.compile(STEMS, re.IGNORECASE)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, str | None]] = {}

        def rows() -> Iterator[tuple]:
            for batch in source:
                for some in slices(batch):
                    there = pc.fill_null(pc.match_substring_regex(some["text"], STEMS, ignore_case=True), False)
                    for row in some.filter(there).to_pylist():
                        found = one(row["text"])
                        if found:
                            yield row["path"], row["text_hash"], *found

        def one(text: str) -> tuple | None:
            score, name = scorer.best(text)
            if score >= least_file:
                return name, score, "file", None
            best: tuple = (0.0, None, None)
            for number, line in enumerate(text.split("\n")):
                if stems.search(line):
                    if line not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[line] = scorer.best(line)
                    if known[line][0] > best[0]:
                        best = (*known[line], number)
            return (best[1], best[0], "header", best[2]) if best[0] >= least_header else None

        yield from batches(rows(), schema)

    return files.select("path", "text_hash", "text").mapInArrow(run, OWN)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, *, templates=TEMPLATES, least_header: float = 0.7, least_file: float = 0.85,
         path_column: str = "path", text_column: str = "text") -> DataFrame:
    """The columns of ``files`` and license, license_score, found, license_path, line.

    ``found`` is ``file`` where the whole text is like a template, ``header`` where line number ``line``
    (from 0) is, ``inherited`` where the license comes from the license file ``license_path``, or null.
    Of several license files of a directory the most similar gives its license, of equal ones the first
    path.  Paths are divided by ``/``.  Null and empty texts have no license of their own; a null path inherits
    nothing and gives nothing to others.  Rows of one path and text share their result.  All rows stay, columns of
    the added names are replaced; an empty table gives no rows.
    """
    made = ["license", "license_score", "found", "license_path", "line"]
    kept = [c for c in files.columns if c not in made]
    p = free(files)
    named = files.select(*kept, F.col(path_column).cast("string").alias(p + "path"), F.xxhash64(text_column).alias(p + "hash"))
    read = files.select(F.col(path_column).cast("string").alias("path"), F.xxhash64(text_column).alias("text_hash"),
                        F.col(text_column).cast("string").alias("text"))
    own = materialise(own_licenses(read, templates, least_header, least_file).dropDuplicates(["path", "text_hash"]))
    given = (own.where("found = 'file' and path is not null")
             .groupBy(_directory(F.col("path")).alias("above"))
             .agg(F.min(F.struct((-F.col("score")).alias("cost"), "path", "license")).alias("from")))
    # Directories, not files, look for what is above them: as many rows as directories and steps up.
    places = named.where(F.col(p + "path").isNotNull()).select(_directory(F.col(p + "path")).alias("place")).distinct()
    steps = places.select("place", F.posexplode(F.reverse(F.transform(
        F.sequence(F.lit(1), F.size(F.split("place", "/"))),
        lambda n: F.array_join(F.slice(F.split("place", "/"), F.lit(1), n), "/")))).alias("up", "above"))
    nearest = (steps.join(given, "above").groupBy("place").agg(F.min_by(F.col("from"), F.col("up")).alias("from")))
    mine = own.select(*[F.col(c).alias(f"{p}own_{c}") for c in own.columns])
    out = named.join(mine, F.col(p + "path").eqNullSafe(F.col(p + "own_path")) & (F.col(p + "hash") == F.col(p + "own_text_hash")), "left")
    nearest = nearest.select(F.col("place").alias(p + "place"), F.col("from").alias(p + "from"))
    out = out.join(nearest, _directory(F.col(p + "path")) == F.col(p + "place"), "left")
    inherited = F.col(p + "own_found").isNull() & F.col(p + "from").isNotNull()
    return out.select(*kept, F.coalesce(p + "own_license", p + "from.license").alias("license"),
                      F.when(inherited, -F.col(p + "from.cost")).otherwise(F.col(p + "own_score")).alias("license_score"),
                      F.when(inherited, "inherited").otherwise(F.col(p + "own_found")).alias("found"),
                      F.when(inherited, F.col(p + "from.path")).alias("license_path"), F.col(p + "own_line").alias("line"))
