"""Licence scan: sparse TF-IDF cosine of a file's passages to licence templates, then inheritance down directories.

A file's own licence is that of the template nearest to one of its passages. A licence file declares its licence for its
directory; files without one of their own take it from the nearest directory above that declares one, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# Public licence notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
]
NEAR = 0.75
TERM = re.compile(r"[a-z0-9]+")
PASSAGE = re.compile(r"(?<=[.!?])\s+|[\r\n]+|\s*\|\s*")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def document_counts(files: DataFrame, text: str, wanted: set[str]) -> tuple[int, dict[str, int]]:
    """The number of files, and of those that hold each of the ``wanted`` terms; counted over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total[""] += 1
                total.update(wanted.intersection(TERM.findall((t or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = files.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}  # a row for each term of the templates
    return found.pop("", 0), found


class Scorer:
    """Cosine of passages to templates. Terms that no template has weigh as those that no file has.

    Passages are the sentences, lines, cells and paragraphs of a text, its whole and, for each template, every run of as
    many terms as it has, so that a notice is found wherever it stands and however its lines are broken or marked.
    """

    def __init__(self, templates: list[tuple[str, str]], files: int, counts: dict[str, int], near: float = NEAR):
        words = {w for _, t in templates for w in terms(t)}
        self.near, self.other = near, math.log(1 + files) + 1
        self.weight = {w: math.log((1 + files) / (1 + counts.get(w, 0))) + 1 for w in words}
        self.templates = [(name, self.vector(terms(t)), len(terms(t))) for name, t in templates]

    def vector(self, words: list[str]) -> dict[str, float]:
        """Term weights over their length."""
        raw = {w: n * self.weight.get(w, self.other) for w, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    def reachable(self, words: set[str], templates: list[int]) -> list[int]:
        """The templates that a passage of these words can be near to: a cosine is at most the length of the part of the
        template's vector that lies on the passage's words."""
        least = self.near * self.near * (1 - 1e-9)
        return [k for k in templates if sum(x * x for w, x in self.templates[k][1].items() if w in words) >= least]

    def runs(self, words: list[str], k: int) -> Iterator[list[str]]:
        """Runs of as many terms as template ``k`` has that can be near to it: repeated terms only lengthen a vector."""
        _, template, size = self.templates[k]
        if len(words) <= size:
            return
        share = np.fromiter((template.get(w, 0.0) for w in words), float, len(words))
        square = np.fromiter((self.weight.get(w, self.other) for w in words), float, len(words)) ** 2
        dot = share * np.sqrt(square)
        total = lambda x: np.cumsum(np.append(0.0, x))[size:] - np.cumsum(np.append(0.0, x))[:-size]
        for i in np.flatnonzero(total(dot) >= self.near * np.sqrt(total(square)) * (1 - 1e-9)).tolist():
            yield words[i : i + size]

    def best(self, text: str | None) -> tuple[float, str | None]:
        """The greatest cosine of a passage to a template and its licence, if it is near; ties go to the first template."""
        text = (text or "").lower()
        words = TERM.findall(text)
        found = self.reachable(set(words), range(len(self.templates)))
        top, at = 0.0, len(self.templates)

        def score(passage: list[str], which: list[int]) -> None:
            nonlocal top, at
            if which:
                own = self.vector(passage)
                for k in which:
                    cosine = sum(x * own.get(w, 0.0) for w, x in self.templates[k][1].items())
                    if cosine >= self.near and (cosine, -k) > (top, -at):
                        top, at = cosine, k

        if found:
            for part in {text, *PARAGRAPH.split(text), *PASSAGE.split(text)}:
                passage = TERM.findall(part)
                score(passage, self.reachable(set(passage), found))
            for k in found:
                for run in self.runs(words, k):
                    score(run, [k])
        return top, self.templates[at][0] if at < len(self.templates) else None


def scan(files: DataFrame, key: str, path: str, text: str, near: float = NEAR, templates=TEMPLATES) -> DataFrame:
    """key, path, own, score, licence, declared_in of every file.

    ``own`` is the licence of the nearest template if the cosine reaches ``near``, and ``score`` is that cosine, else 0;
    ``licence`` is ``own`` or what the
    nearest directory above (its own included) declares, which ``declared_in`` names. The licence file of a directory
    with the greatest score declares for it, then the first by path. A null path has no directory and inherits nothing;
    null and empty texts have no licence of their own. Repeated rows are judged one by one, texts of any length whole;
    other columns, whatever their names, are not read. An empty table gives no rows.
    """
    words = {w for _, t in templates for w in terms(t)}
    scorer = Scorer(templates, *document_counts(files, text, words), near)
    shared = files.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [shared.value.best(t) for t in some.column(2).to_pylist()]
                score, own = [s for s, _ in found], [n for _, n in found]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(own, pa.string()), pa.array(score, pa.float64())], names=["key", "path", "own", "score"])

    rows = cut(files.select(F.col(key).cast("long").alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, path string, own string, score double"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)  # empty for the top
    rows = rows.withColumn("dir", F.when(F.col("path").isNotNull(), folder))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    declared = rows.where("own is not null and path is not null").where(name.rlike(FILE)).groupBy("dir").agg(F.min_by("own", F.struct(-F.col("score"), F.col("path"), F.col("own"))).alias("licence"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = rows.where("dir is not null").select("dir").distinct().withColumn("up", F.explode(F.array_distinct(above)))
    near_dir = dirs.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("licence", "up"), F.length("up")).alias("d"))
    near_dir = cut(near_dir.select(F.col("dir").alias("_dir"), "d.licence", F.col("d.up").alias("declared_in")))  # a row for each directory
    out = rows.join(near_dir, F.col("dir") == F.col("_dir"), "left")
    return out.select(F.col("key").alias(key), "path", "own", "score", F.coalesce("own", "licence").alias("licence"), F.when(F.col("own").isNull(), F.col("declared_in")).alias("declared_in"))


def licence_query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents as files; paths, which the table lacks, follow from source and id, each seventh a licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.col("doc_id") % 7 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    place = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("d"), F.col("doc_id") % 50), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)), name)
    return scan(docs.select("doc_id", place.alias("path"), "text"), "doc_id", "path", "text")
