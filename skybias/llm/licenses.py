"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a file, every block that begins with a line and has as many words as a template, and the file as a whole are vectors of
hashed words, weighted by tf * ln((1 + N) / (1 + df)) + 1 with the document frequencies of the whole corpus (``BUCKETS`` counts, a table
of fixed size). The best template at a cosine of at least its kind's threshold is the file's own licence. A file without one takes that
of a licence file in its directory or the nearest directory above.

Templates are an argument. The default ones are short notices, the usual headers and the full texts of common licences
(``license_texts/NAME.KIND.txt``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from importlib import resources
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm import texts
from skybias.llm.registry import query
from skybias.llm.tables import stored, table, text_of

BUCKET_BITS, THRESHOLD = 18, 0.6
BUCKETS = 1 << BUCKET_BITS
FILE_THRESHOLD = 0.95  # texts of different licences are alike: without rare words to weigh, GFDL to GPL 0.92, MPL 1.1 to 2.0 0.945
#: Names of licence files in lower case: LICENSE, COPYING.LESSER, LICENSE-MIT, MIT-LICENSE.txt, UNLICENSE, but not license.py.
LICENSE_NAMES = (r"^(?!.*\.(?:py|pyi|c|h|cc|cpp|hpp|cs|go|rs|rb|js|jsx|ts|tsx|java|kt|php|pl|sh|json|xml|ya?ml|toml|css|svg|png)$)"
                 r"(?:[a-z0-9.+]+[-_.])?(?:un)?(?:licen[cs]es?|copying|copyright|notices?)(?:[-_.][a-z0-9.+_-]*)?$")


class Template(NamedTuple):
    """``kind``: header (a notice that declares a licence), file (a licence's text), or part (a sentence of such a text, which decides
    only where no header or file does)."""

    name: str
    kind: str
    text: str


# Notices in one sentence.
NOTICES = (
    Template("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    Template("BSD-2-Clause", "header", "Licensed under the BSD 2-Clause License."),
    Template("BSD-3-Clause", "header", "Licensed under the BSD 3-Clause License."),
    Template("BSD-3-Clause", "part", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("CC-BY-4.0", "header", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "header", "Licensed under CC BY-SA 4.0."),
    Template("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    Template("LGPL-3.0", "header", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("MIT", "header", "Released under the MIT License."),
    Template("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def common_templates() -> list[Template]:
    """The notices and the packaged headers and texts."""
    packed = [f for f in (resources.files("skybias.llm") / "license_texts").iterdir() if f.name.endswith(".txt")]
    return sorted([*NOTICES, *(Template(*f.name.removesuffix(".txt").rsplit(".", 1), f.read_text(encoding="utf8")) for f in packed)])


_CLOSING, _OPENING = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".,;:()\"'`*/>", b"(\"'`*/#<"))
_SAYS = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)) | (np.arange(256) > 127)


def _bare(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without punctuation and comment marks around them."""
    for _ in range(3):
        ends = ends - (_CLOSING[raw[ends - 1]] & (ends - starts > 1))
        starts = starts + (_OPENING[raw[starts]] & (ends - starts > 1))
    return starts, ends


def _units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges with word hashes, the line number of each word (over the range) and the offset of each row's words.

    Words without a letter or digit (comment marks, rules) don't count.
    """
    raw, offsets = texts.buffers(column)
    for a, b in texts.slices(offsets):
        part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, _ = texts.spans(part, at)
        says = np.concatenate([[0], np.cumsum(_SAYS[part])])
        keep = says[ends] > says[starts]
        starts, ends = starts[keep], ends[keep]
        first = np.searchsorted(starts, at)
        breaks = np.cumsum(part == 10)
        breaks = np.append(breaks, breaks[-1] if len(breaks) else 0)
        row = np.repeat(np.arange(b - a), np.diff(first))
        yield a, b, texts.hashes(part, *_bare(part, starts, ends)), breaks[starts] + row, first


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for a, b, word, _, first in _units(batch.column("text")):
            row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(first))
            counts += np.bincount(np.unique(row << BUCKET_BITS | (word >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)) & (BUCKETS - 1), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(found), pa.array(counts[found])], ["bucket", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([c.to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], batch.schema.names)


def inverse_frequencies(files: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of each bucket."""
    rows = files.select(text_of().alias("text")).mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS)
    for r in rows.mapInArrow(_pack, "bucket binary, n binary").collect():
        counts[np.frombuffer(bytes(r["bucket"]), np.int64)] = np.frombuffer(bytes(r["n"]), np.int64)
    return (np.log((1 + files.count()) / (1 + counts)) + 1).astype(np.float32)


def _cosines(word: np.ndarray, unit: np.ndarray, units: int, weight: np.ndarray, vocabulary: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Cosine of each unit with each template; only units that share a word with a template can be above 0."""
    at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    shared = vocabulary[at] == word
    wanted = np.zeros(units, bool)
    wanted[unit[shared]] = True
    keep = wanted[unit]
    word, unit, at, shared = word[keep], unit[keep], at[keep], shared[keep]
    order = np.lexsort((word, unit))
    word, unit, at, shared = word[order], unit[order], at[order], shared[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (unit[1:] != unit[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(word)))
    value = tf * weight[(word[first] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    unit, at, shared = unit[first], at[first], shared[first]
    norm = np.sqrt(np.bincount(unit, value * value, units))
    out = np.zeros((units, len(templates)))
    at, value, unit = at[shared], value[shared], unit[shared]
    if len(unit):
        begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        for t, template in enumerate(templates):
            out[unit[begin], t] = np.add.reduceat(value * template[at], begin)
    return out / np.maximum(norm, 1e-12)[:, None]


def _square_norms(word: np.ndarray, square: np.ndarray, size: int) -> np.ndarray:
    """Sum of (tf * idf)^2 of the ``size`` words from each word on (fewer at the end); ``square`` is idf^2.

    A word that enters at a term frequency of f adds (2 f + 1) idf^2, one that leaves takes (2 f - 1) idf^2 away.
    """
    n = len(word)
    ids = np.unique(word, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(ids, kind="stable")
    keys, place = ids[order] * (n + 1) + order, np.empty(n, np.int64)
    place[order] = np.arange(n)
    here = np.arange(n)
    leaves = square * (2 * (np.searchsorted(keys, ids * (n + 1) + np.minimum(here + size, n)) - place) - 1)
    enters = square * (2 * (place - np.searchsorted(keys, ids * (n + 1) + np.maximum(here - size + 1, 0))) + 1)
    step = -leaves
    step[:max(n - size, 0)] += enters[size:]
    return enters[:size].sum() + np.concatenate([[0.0], np.cumsum(step)[:-1]])


def _block_cosines(best: np.ndarray, word: np.ndarray, line: np.ndarray, first: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray,
                   templates: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> None:
    """Raise ``best`` (rows by templates) to the cosines of blocks: as many words as the template has, from a line's start on.

    With every term frequency taken as 1 a block's norm is at least as large, so a running sum bounds all cosines from above; only rows
    with a block over ``least`` are worked out.
    """
    at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    shared = np.flatnonzero(vocabulary[at] == word)
    if not len(shared):
        return
    begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    owner = np.searchsorted(first, begins, "right") - 1
    value = weight[(word >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.float64)
    square = value * value
    total, part, at = np.concatenate([[0.0], np.cumsum(square)]), value[shared], at[shared]
    left, norms = np.searchsorted(shared, begins), {}
    for t, template in enumerate(templates):
        ends = np.minimum(begins + sizes[t], first[owner + 1])
        sums = np.concatenate([[0.0], np.cumsum(part * template[at])])
        dot = sums[np.searchsorted(shared, ends)] - sums[left]
        bound = dot / np.sqrt(total[ends] - total[begins])
        for r in np.unique(owner[bound >= np.maximum(least[t], best[owner, t]) - 1e-9]):
            a, b = first[r], first[r + 1]
            if (r, sizes[t]) not in norms:
                norms[r, sizes[t]] = _square_norms(word[a:b], square[a:b], int(sizes[t]))
            mine = owner == r
            cosine = dot[mine] / np.sqrt(norms[r, sizes[t]][begins[mine] - a])
            top = min(cosine.max(), 1.0)
            if top >= least[t] - 1e-9:
                best[r, t] = max(best[r, t], top)


def _template_vectors(known: Sequence[Template], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.concatenate([w for _, _, w, _, _ in _units(pa.array([t.text]))]) for t in known]
    vocabulary = np.unique(np.concatenate(parts))
    out = np.zeros((len(parts), len(vocabulary)))
    for i, words in enumerate(parts):
        np.add.at(out[i], np.searchsorted(vocabulary, words), 1.0)
    out *= weight[(vocabulary >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    return vocabulary, out / np.linalg.norm(out, axis=1, keepdims=True), np.array([len(p) for p in parts])


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, templates: Sequence[Template] | None = None,
                 file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """(path, license, cosine) of every row of ``files`` (path, text): the best template of its lines, its blocks and the whole text.

    Ties go to the first template. Null and empty texts, and texts below the thresholds (``file_threshold`` for licence texts), have a null
    license; cosine is then the best one of a line or the whole.
    """
    known = list(common_templates() if templates is None else templates)
    weight = inverse_frequencies(files)
    least = np.array([file_threshold if t.kind == "file" else threshold for t in known])
    rank = np.array([t.kind != "part" for t in known]) * 2.0
    names = [t.name for t in known]
    shared = files.sparkSession.sparkContext.broadcast((weight, *_template_vectors(known, weight)))  # some MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, vocabulary, vectors, sizes = shared.value
        for batch in batches:
            for a, b, word, line, first in _units(batch.column("text")):
                row = np.repeat(np.arange(b - a), np.diff(first))
                best = _cosines(word, row, b - a, weight, vocabulary, vectors) if len(word) else np.zeros((b - a, len(names)))
                if len(word):
                    lines, back = np.unique(line, return_inverse=True)
                    owner = np.zeros(len(lines), np.int64)
                    owner[back] = row
                    np.maximum.at(best, owner, _cosines(word, back, len(lines), weight, vocabulary, vectors))
                    _block_cosines(best, word, line, first, weight, vocabulary, vectors, sizes, least)
                best = best.round(9)
                passed = best >= least
                which = np.where(passed, best + rank, -1.0).argmax(1)
                some = passed.any(1)
                top = np.where(some, best[np.arange(b - a), which], best.max(1))
                found = [names[w] if ok else None for w, ok in zip(which, some, strict=True)]
                yield pa.record_batch([batch.column("path").slice(a, b - a), pa.array(found, pa.string()), pa.array(top)], ["path", "license", "cosine"])

    return files.select("path", text_of().alias("text")).mapInArrow(run, "path string, license string, cosine double")


def scan(files: DataFrame, threshold: float = THRESHOLD, templates: Sequence[Template] | None = None,
         file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """(path, license, cosine, inherited_from) of every row of ``files`` (path, text).

    inherited_from is the directory whose licence file decides, null for a file's own licence or none. Where a directory has several licence
    files, the highest cosine decides, then the first name. Rows with the same path are scanned one by one. A null path
    inherits nothing.
    """
    own = stored(own_licenses(files, threshold, templates, file_threshold), "licenses")
    parts = F.split("path", "/")
    own = own.withColumns({"dir": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), "name": F.lower(F.element_at(parts, -1))})
    holders = (own.where(F.col("name").rlike(LICENSE_NAMES) & F.col("license").isNotNull())
               .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("s")).select(F.col("dir").alias("above"), F.col("s.license").alias("given")))
    # directories, not files, meet their ancestors
    dirs = own.where("license IS NULL AND path IS NOT NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"), steps.alias("steps"))
    ancestors = ancestors.select("dir", "depth", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = (ancestors.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("s"))
               .select("dir", F.col("s.above").alias("inherited_from"), F.col("s.given").alias("given")))
    rows = own.join(nearest, "dir", "left")
    return rows.select("path", F.coalesce("license", "given").alias("license"), "cosine",
                       F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source / doc_id by 4096 / doc_id by 64 / name; the first of a folder is its LICENSE file, if it holds a licence."""
    n = F.col("doc_id")
    name = F.when(F.pmod(n, F.lit(64)) == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    folder = F.when(F.pmod(n, F.lit(4096)) == 0, F.lit(None)).otherwise(F.shiftright(n, 6).cast("string"))
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.shiftright(n, 12).cast("string"), folder, name))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
