"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, spread_join

COSINE = 0.7
# Notices by which works declare their licence, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License, Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License, Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License, Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
]
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")
_SPDX_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
TEMPLATES += [(k, f"SPDX-License-Identifier: {k}") for k in _SPDX]
TEMPLATES += [(k, f"SPDX-License-Identifier: {k}{end}") for k in _SPDX_GNU for end in ("", "-only", "-or-later")]
# Whole licences, without a holder's line; of AGPL-3.0 and the Creative Commons ones but CC0 only titles are known.
TEMPLATES += [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
#: Paragraphs at a text's head that are also compared together, up to each of them.
HEAD = 12
_WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*").findall


def terms(line: str) -> Counter:
    return Counter(_WORDS(line.lower()))


class Scanner:
    """Templates as sparse unit vectors, by term. Terms of no template weigh as if one document had them."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], n_docs: int):
        self.names = [k for k, _ in templates]
        self.rare = math.log((n_docs + 1) / 1.0) + 1
        self.idf = {t: math.log((n_docs + 1) / (df.get(t, 0) + 1)) + 1 for _, x in templates for t in terms(x)}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.mass = []
        for i, (_, x) in enumerate(templates):
            v = {t: c * self.idf[t] for t, c in terms(x).items()}
            size = math.sqrt(sum(w * w for w in v.values()))
            self.mass.append(size)
            for t, w in v.items():
                self.by_term.setdefault(t, []).append((i, w / size))
        self.most = {t: max(w for _, w in x) for t, x in self.by_term.items()}

    def score(self, line: str | Counter) -> tuple[str | None, float]:
        """The template nearest to a line, or to the terms of several, and its cosine; the first by order on a tie."""
        v = {t: c * self.idf.get(t, self.rare) for t, c in (terms(line) if isinstance(line, str) else line).items()}
        dots: dict[int, float] = {}
        for t in v.keys() & self.by_term.keys():
            for i, w in self.by_term[t]:
                dots[i] = dots.get(i, 0.0) + w * v[t]
        if not dots:
            return None, 0.0
        i = min(dots, key=lambda k: (-round(dots[k], 12), k))
        return self.names[i], dots[i] / math.sqrt(sum(w * w for w in v.values()))

    def reaches(self, line: Counter, cosine: float) -> bool:
        """False if the line's terms cannot reach the cosine: a dot product is at most the sum of each weight times the
        largest that its term has in any template."""
        dot = square = 0.0
        for t, c in line.items():
            w = c * self.idf.get(t, self.rare)
            square += w * w
            dot += w * self.most.get(t, 0.0)
        return dot > 0 and dot * (1 + 1e-9) >= cosine * math.sqrt(square)


def scanners_of(templates: list[tuple[str, str]], df: dict[str, int], n_docs: int) -> list[Scanner]:
    """One for notices of a line and one for whole licences, so that the many words of these, which others weigh as rare,
    don't change the weights of a line."""
    lines, texts = [x for x in templates if "\n" not in x[1].strip()], [x for x in templates if "\n" in x[1].strip()]
    return [Scanner(x, df, n_docs) for x in (lines, texts) if x]


def nearest(scanners: list[Scanner], x: Counter, cosine: float) -> tuple[str | None, float]:
    """The nearest template if it reaches the cosine, or else none and 0."""
    found = [s.score(x) for s in scanners if s.reaches(x, cosine)]
    return max((f for f in found if f[1] >= cosine), key=lambda f: f[1], default=(None, 0.0))


def blocks(scanners: list[Scanner], lines: list[Counter], cosine: float) -> tuple[list[tuple[float, str]], bool]:
    """(-cosine, name) of the blocks of several lines that reach the cosine, and whether the whole text does. Blocks
    are paragraphs, parted by lines without a term, the head up to each of the first HEAD, and the whole."""
    parts, fresh, whole, found = [], True, Counter(), []
    for x in lines:
        if x:
            if fresh:
                parts.append([Counter(), 0])
            parts[-1][0].update(x)
            parts[-1][1] += 1
        fresh = not x
    tried = [x for x, n in parts if n > 1 and len(parts) > 1]
    for k, (x, _) in enumerate(parts):
        whole.update(x)
        if 0 < k < min(HEAD, len(parts) - 1):
            tried.append(Counter(whole))
    is_file = False
    for x in [*tried, whole]:
        name, c = nearest(scanners, x, cosine)
        if name:
            found.append((-c, name))
            is_file = x is whole
    return found, is_file


def _presence(vocab: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(vocab.intersection(_WORDS((t or "").lower())))
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return run


def _scan(scanners: list[Scanner], cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, scores, counts, files, names = [], [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                found = []
                lines = (t or "").split("\n")
                counted = [terms(x) for x in lines]
                for x in counted:
                    name, c = nearest(scanners, x, cosine)
                    if name:
                        found.append((-c, name))
                notices = len(found)
                more, whole = blocks(scanners, counted, cosine)
                found += more
                best.append(min(found)[1] if found else None)
                scores.append(-min(found)[0] if found else None)
                counts.append(notices)
                files.append(whole or bool(notices) and notices == sum(bool(x.strip()) for x in lines))
                names.append(sorted({name for _, name in found}))
            new = [pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(files, pa.bool_()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "license", "score", "n_notices", "is_file", "licenses"])

    return run


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, cosine: float = COSINE, carry: list[str] | None = None) -> DataFrame:
    """One row per row of files: the carry columns, path, license, score, n_notices, is_file, licenses, effective,
    inherited_from.

    Document frequencies of the templates' terms are counted over all files. Every line of every whole text is compared to
    them, unless a bound from its terms shows that it cannot reach `cosine`, and so are its paragraphs, the paragraphs at its head together and the
    text as a whole; license is the nearest template of all these that reach `cosine`, licenses has each of them once,
    n_notices counts the lines. A file
    that is nothing but notices, or reaches it as a whole, is a licence file. A file without a notice of its own takes the license of the nearest
    directory above it that has a licence file (the first license by name if it has several): directories, each once, are
    joined to those of their ancestors that have one, and files to their directory, so neither a large directory nor the
    root gathers rows. The root is above every path, with a slash at its start or not; its name is empty. Null or empty texts have no license, null paths inherit nothing; ties, repeated rows and other
    columns change nothing.
    """
    spark = files.sparkSession
    small_batches(spark)
    carry = carry or []
    vocab = frozenset(t for _, x in templates for t in terms(x))
    seen = dict(files.select(F.col(text).cast("string").alias("text")).mapInArrow(_presence(vocab), "term string, n long").groupBy("term").agg(F.sum("n")).collect())
    scanners = scanners_of(templates, seen, seen.get("", 0))
    rows = files.select(*carry, F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(_scan(scanners, cosine), f"{kinds}, license string, score double, n_notices long, is_file boolean, licenses array<string>")
    found = materialise(found.withColumn("dir", F.regexp_replace("path", "(^|/)[^/]*$", "")), "licenses")
    declared = materialise(found.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.min("license").alias("declared")), "declared")
    dirs = found.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/", -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ups))).alias("up"))
    above = materialise(above, "ancestors")
    nearest = spread_join(above, declared.withColumnRenamed("dir", "up"), ["up"]).groupBy("dir").agg(F.max_by(F.struct("up", "declared"), F.length("up")).alias("from"))
    out = spread_join(found, materialise(nearest, "nearest"), ["dir"], "left")
    return out.select(
        *carry, "path", "license", "score", "n_notices", "is_file", "licenses", F.coalesce("license", F.col("from.declared")).alias("effective"),
        F.when(F.col("license").isNull(), F.col("from.up")).alias("inherited_from"),
    )
