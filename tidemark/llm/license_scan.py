"""Operator 10: license scans by sparse TF-IDF cosine, with inheritance from the nearest ancestor directory.

Every run of as many words as a template has is compared with it as a sparse vector of term counts times inverse
document frequencies, which are counted over all words of all files; lines and cue words play no part. Only runs that
can reach `least` are looked at: a template's rarest terms (its keys) are those without which the rest of its vector is
shorter than `least`, so a run without a key cannot reach it, nor can one whose terms of the template are too few
(Cauchy-Schwarz). A run that lacks every term that only its licence's templates have (the name, the version) does not
count, if the template has such terms. A file takes the template of the highest cosine, the earliest of equal ones. A
licence file is one whose name says so, or one of which such runs are at least `share` of the words. Files without a licence of their own inherit that of the
licence file in the nearest directory above them: each path is joined with the licence files of its ancestors'
paths, and the deepest wins (of several in one directory the one of the highest similarity, then the smallest path).

Defined cases: null or empty text has no licence of its own; a null path has no ancestors; repeated rows give a row
each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_batches, small_batches
from tidemark.session import cut, sized_broadcast

#: Terms that a task counts before it hands them on.
MOST_TERMS = 300_000
_TERM = re.compile(r"[a-z0-9.+-]*[a-z0-9+]", re.IGNORECASE)
_PARTS = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int64()), ("terms", pa.list_(pa.string()))]))
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"

#: A usual header or opening of each licence.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License v3.0."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions of the BSD 3-Clause License are met.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to the conditions of the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Copyright. All rights reserved."],
}


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Templates:
    """Unit vectors of the templates under inverse document frequencies, their lengths, keys and telling terms."""

    def __init__(self, templates: dict[str, list[str]], files: int, held: dict[str, int], least: float):
        own = Counter(t for texts in templates.values() for x in texts for t in set(terms(x)))
        self.n, self.least = files + sum(map(len, templates.values())), least
        self.rarity = {t: self.weight(own[t] + held.get(t, 0)) for t in own}
        licences = Counter(t for texts in templates.values() for t in {t for x in texts for t in terms(x)})
        self.all = [(name, *self.vector(terms(x), licences)) for name, texts in sorted(templates.items()) for x in texts if terms(x)]
        self.by_key: dict[str, list[int]] = {}
        for i, (_, unit, _, _) in enumerate(self.all):
            rest = sum(x * x for x in unit.values())
            for t in sorted(unit, key=lambda t: (-unit[t], t)):
                if rest < least * least - 1e-9:
                    break
                self.by_key.setdefault(t, []).append(i)
                rest -= unit[t] ** 2

    def weight(self, held: int) -> float:
        return math.log((1 + self.n) / (1 + held)) + 1

    def vector(self, found: list[str], licences: dict[str, int]) -> tuple[dict[str, float], int, set[str]]:
        v = {t: k * self.rarity[t] for t, k in Counter(found).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}, len(found), {t for t in v if licences[t] == 1}

    def regions(self, found: list[str]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of the parts of a text in which a run of the template's length can reach `least`."""
        if not found or self.by_key.keys().isdisjoint(found):
            return []
        out: dict[int, list[list[int]]] = {}
        for at in [i for i, t in enumerate(found) if t in self.by_key]:
            for k in self.by_key[found[at]]:
                _, unit, length, telling = self.all[k]
                a, b = max(0, at - length + 1), min(len(found), at + length)
                near = set(found[a:b])
                if sum(unit[t] ** 2 for t in near if t in unit) < self.least**2 - 1e-9 or (telling and telling.isdisjoint(near)):
                    continue
                mine = out.setdefault(k, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = b
                else:
                    mine.append([a, b])
        return sorted((k, a, b) for k, parts in out.items() for a, b in parts)

    def runs(self, k: int, found: list[str], held: dict[str, int]) -> Iterator[tuple[int, int, float]]:
        """(first word, end, cosine) of the runs of template k in a region; held: files that hold each word outside the templates."""
        _, unit, length, telling = self.all[k]
        weight = [self.rarity[t] if t in self.rarity else self.weight(held.get(t, 0)) for t in found]
        count: Counter[str] = Counter()
        for end in range(1, len(found) + 1):
            count[found[end - 1]] += 1
            if end > length:
                count[found[end - 1 - length]] -= 1
            start = max(0, end - length)
            if end < min(length, len(found)) or (telling and not any(count[t] for t in telling)):
                continue
            dot = sum(x * count[t] * self.rarity[t] for t, x in unit.items())
            size = math.sqrt(sum(count[t] * w * w for t, w in zip(found[start:end], weight[start:end])))
            yield start, end, dot / size


def term_frequencies(files: DataFrame) -> DataFrame:
    """term, n: the files that hold each term, over all terms of all files."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in byte_batches(batches):
            for text in batch.column("text").to_pylist():
                held.update(set(terms(text or "")))
                if len(held) > MOST_TERMS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def ancestors(path):
    """The directories above a path, nearest first, down to the empty root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def license_scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.6, share: float = 0.2) -> DataFrame:
    """file_id, path, license, similarity, how (own, inherited or none), found_in for every row of files (file_id, path, text)."""
    small_batches(files)
    templates = templates or TEMPLATES
    narrow = files.select("file_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    vocabulary = sorted({t for texts in templates.values() for x in texts for t in terms(x)})
    counts = cut(term_frequencies(narrow))
    asked = files.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    known = {r.term: r.n for r in counts.join(F.broadcast(asked), "term").collect()}
    sent = files.sparkSession.sparkContext.broadcast(Templates(templates, narrow.count(), known, least))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches):
            parts, sizes = [], []
            for text in batch.column("text").to_pylist():
                found = terms(text or "")
                parts.append([{"k": k, "at": a, "terms": found[a:b]} for k, a, b in sent.value.regions(found)])
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("path"), pa.array(sizes, pa.int64()), pa.array(parts, _PARTS)], names=["file_id", "path", "size", "parts"])

    kind = narrow.schema["file_id"].dataType.simpleString()
    found = narrow.mapInArrow(find, f"file_id {kind}, path string, size long, parts array<struct<k: int, at: long, terms: array<string>>>")
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    others = found.where(F.size("parts") > 0).select("_row", F.explode(F.array_distinct(F.flatten(F.col("parts.terms")))).alias("term")).join(F.broadcast(asked), "term", "left_anti")
    rare = sized_broadcast(cut(counts.join(others.select("term").distinct(), "term")))
    held = others.join(rare, "term").groupBy("_row").agg(F.collect_list(F.struct("term", "n")).alias("held"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for size, parts, held in zip(*(batch.column(c).to_pylist() for c in ("size", "parts", "held"))):
                frequency = {h["term"]: h["n"] for h in held or []}
                runs = [(p["at"] + a, sent.value.all[p["k"]][0], p["at"] + b, value) for p in parts for a, b, value in sent.value.runs(p["k"], p["terms"], frequency) if value >= least]
                best, covered = (None, None), set()
                for a, name, b, value in sorted(runs):
                    covered.update(range(a, b))
                    if best[1] is None or value > best[1] + 1e-12:
                        best = (name, value)
                rows.append((*best, bool(runs) and len(covered) >= share * size))
            name, value, main = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(name, pa.string()), pa.array(value, pa.float64()), pa.array(main, pa.bool_())], names=["_row", "license", "similarity", "main"])

    judged = found.where(F.size("parts") > 0).join(held, "_row", "left").select("_row", "size", "parts", "held").mapInArrow(judge, "_row long, license string, similarity double, main boolean")
    scanned = cut(found.select("file_id", "path", "_row").join(judged, "_row", "left"))
    holders = scanned.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("main") | F.col("path").rlike(_NAMED)))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    top = holders.withColumn("dir", directory)
    best = top.groupBy("dir").agg(F.max("similarity").alias("similarity"))
    first = cut(top.join(best, ["dir", "similarity"]).groupBy("dir").agg(F.min_by("license", F.struct("path", "license")).alias("from_license"), F.max("similarity").alias("from_similarity"), F.min("path").alias("from_path")))
    left = F.struct("from_license", "from_similarity", "from_path")
    bare = scanned.where(F.col("license").isNull() & F.col("path").isNotNull()).select("_row", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    heirs = bare.where("dir <> ''").join(sized_broadcast(first), "dir").groupBy("_row").agg(F.min_by(left, "up").alias("from"))
    root = first.where("dir = ''").agg(F.first(left).alias("_root"))  # one row, which every path has above it
    out = scanned.join(heirs, "_row", "left").join(F.broadcast(root))
    out = out.withColumn("from", F.when(F.col("license").isNull() & F.col("path").isNotNull(), F.coalesce("from", "_root")))
    return out.select(
        "file_id", "path", F.coalesce("license", "from.from_license").alias("license"), F.coalesce("similarity", "from.from_similarity").alias("similarity"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("from.from_path")).alias("found_in"),
    )
