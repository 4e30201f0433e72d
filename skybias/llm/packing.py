"""Vector bin packing of documents into training sequences.

Each task packs the documents of its partition on its own. A document longer than a sequence gives full sequences first; what is
left of it waits in a window of ``window`` items. An open sequence takes the item with the largest dot product of its demands
(tokens, one segment, loss-bearing tokens) and the sequence's free capacities, both as shares of the limits; an item larger than
the free tokens is cut. A sequence that reaches a limit before it is full ends at a power of two, where it needs no padding: what
lies beyond goes back to the window. The last tokens of a task are packed the same way, so no token of padding remains unless
the limit of loss-bearing tokens forces it.

State is one window per task, whatever the size of the partition. Sequence ids carry the partition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skybias.llm.registry import query
from skybias.llm.tables import table
from skybias.llm.tokens import END_OF_TEXT, default_path, encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


class Packer:
    """Packs items (ids with a loss mask) into sequences; ``put`` and ``finish`` return finished pieces."""

    def __init__(self, size: int, segments: int, loss: int, window: int, sequence_id: int):
        self.size, self.limit, self.window, self.sequence_id = size, np.array([size, segments, loss], float), window, sequence_id
        self.items: list[tuple | None] = [None] * (window + 2)
        self.demand = np.zeros((window + 2, 3))
        self.free = list(range(window + 2))

    def _hold(self, item: tuple) -> None:
        at = self.free.pop()
        self.items[at], self.demand[at] = item, (len(item[2]), 1, item[3].sum())

    def put(self, doc_id, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple]:
        self._hold((doc_id, 0, ids, loss, len(ids)))
        while len(self.free) < 2:
            yield from self._sequence()

    def finish(self) -> Iterator[tuple]:
        while len(self.free) < len(self.items):
            yield from self._sequence()

    def _sequence(self) -> Iterator[tuple]:
        """Fill one sequence."""
        room, chosen = self.limit.copy(), []
        while room.min() >= 1 and len(self.free) < len(self.items):
            # a demand counts up to what is free: the rest of a long item stays for the next sequence
            best = int(np.argmax((np.minimum(self.demand, room) / self.limit) @ (room / self.limit)))
            doc_id, start, ids, loss, total = item = self.items[best]
            take = min(len(ids), int(room[0]))
            bearing = np.cumsum(loss[:take])
            if bearing[-1] > room[2]:
                take = int(np.searchsorted(bearing, room[2], "right"))
                if take == 0:
                    break
            chosen.append((doc_id, start, ids[:take], loss[:take], total))
            room -= (take, 1, int(bearing[take - 1]))
            if take == len(ids):
                self.items[best], self.demand[best] = None, 0
                self.free.append(best)
            else:
                self.items[best] = (doc_id, start + take, ids[take:], loss[take:], total)
                self.demand[best] = (len(ids) - take, 1, loss[take:].sum())
            del item
        filled = sum(len(c[2]) for c in chosen)
        keep = filled if filled == self.size else 1 << (filled.bit_length() - 1)
        at = 0
        for doc_id, start, ids, loss, total in chosen:
            n = min(len(ids), keep - at)
            if n:
                yield doc_id, start, n, total, self.sequence_id, at, int(loss[:n].sum()), ids[:n].astype("<u4").tobytes()
                at += n
            if n < len(ids):
                self._return((doc_id, start + n, ids[n:], loss[n:], total))
        self.sequence_id += 1

    def _return(self, item: tuple) -> None:
        """Put back what a sequence leaves over, joined with the rest of the same document where that waits."""
        for at, other in enumerate(self.items):
            if other is not None and other[0] == item[0] and other[1] == item[1] + len(item[2]) and other[4] == item[4]:
                self.items[at] = (item[0], item[1], np.concatenate([item[2], other[2]]), np.concatenate([item[3], other[3]]), item[4])
                self.demand[at] = (len(self.items[at][2]), 1, self.items[at][3].sum())
                return
        if not self.free:
            self.items.append(None)
            self.demand = np.vstack([self.demand, np.zeros(3)])
            self.free.append(len(self.items) - 1)
        self._hold(item)


def _all_bear_loss(batch: pa.RecordBatch, row: int, ids: np.ndarray) -> np.ndarray:
    return np.ones(len(ids), np.int8)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, max_segments: int = 1024, max_loss_tokens: int | None = None,
         window: int = 128, loss_mask: Callable[[pa.RecordBatch, int, np.ndarray], np.ndarray] = _all_bear_loss, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its ids as little-endian unsigned 32-bit numbers.

    ``loss_mask(batch, row, ids)`` marks the loss-bearing tokens of a row, from the columns named in ``extra`` if need be. A null or
    empty text is one token, the end of text. Repeated rows are packed once for each row; a null doc_id stays null. No row, no piece.
    """
    path = tokenizer or default_path()
    limit = size if max_loss_tokens is None else max_loss_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path), Packer(size, max_segments, limit, window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, b, ids, first in coder.encode(batch.column("text")):
                done = []
                for i in range(b - a):
                    own = np.append(ids[first[i]:first[i + 1]], np.uint32(END_OF_TEXT))
                    done += packer.put(names[a + i], own, loss_mask(batch, a + i, own))
                if done:
                    yield _table(done)
        done = list(packer.finish())
        if done:
            yield _table(done)

    return docs.select("doc_id", "text", *extra).mapInArrow(run, PIECES)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
