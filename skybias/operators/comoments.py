"""Sums behind all pairwise correlations of some columns, in one pass with a few small matrix products for each batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 2048


def _sums(keys: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], type_) for i, type_ in enumerate(types)]
            return pa.record_batch([*columns, pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], [*keys, "sums"])

        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            code = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                encoded = batch.column(k).dictionary_encode(null_encoding="encode")
                code = code * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy()
            there = np.column_stack([~np.asarray(batch.column(c).is_null()) for c in names]).astype(float)
            value = np.where(there > 0, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]), 0.0)
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1])) if len(order) else []
            first = batch.select(keys).take(pa.array(order[start])).to_pylist() if len(order) else []
            for row, at in zip(first, np.split(order, start[1:]), strict=True) if len(order) else ():
                v, t = value[at], there[at]
                key = tuple(row[k] for k in keys)
                # rows with both; sum, square sum of the first column over them; sum of products
                held[key] = held.get(key, 0) + np.stack([t.T @ t, v.T @ t, (v * v).T @ t, v.T @ v])
            if len(held) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    return run


def pair_sums(rows: DataFrame, keys: list[str], names: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, ``_pair``, ``_n``, ``_sa``, ``_sb``, ``_ab``, ``_aa``, ``_bb``): sums over the rows that have both columns of a pair.

    A task sends one row for each group and pair that it has seen, whatever its rows.
    """
    k = len(names)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    found = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(_sums(keys, names), f"{kinds}, sums array<double>")
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = names.index(a), names.index(b)
        at = {"_n": (0, x, y), "_sa": (1, x, y), "_sb": (1, y, x), "_ab": (3, x, y), "_aa": (2, x, y), "_bb": (2, y, x)}
        parts.append((i, [m * k * k + r * k + c for m, r, c in at.values()]))
    places = "array(" + ", ".join(f"array({', '.join(map(str, p))})" for _, p in parts) + ")"
    long = found.selectExpr(*keys, "sums", f"posexplode({places}) AS (_pair, _at)")
    columns = ["_n", "_sa", "_sb", "_ab", "_aa", "_bb"]
    long = long.selectExpr(*keys, "_pair", *[f"sums[_at[{i}]] AS {c}" for i, c in enumerate(columns)])
    return long.groupBy(*keys, "_pair").agg(*[F.sum(c).alias(c) for c in columns]).where("_n > 0")
