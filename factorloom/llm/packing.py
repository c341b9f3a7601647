"""Hierarchical multi-length packing.

Documents are cut into whole top-tier windows and a rest, and each rest is routed to the smallest tier
that holds it. Windows are filled from the longest tier down: the longest rest first, then the longest
that fit the gap, from the same tier or shorter ones; only what then remains of the gap is filled by
cutting. Every window so made is exactly full. A task keeps what can't fill a window; those rests of
neighbouring tasks are packed together in a second, small step. Windows are dealt to step groups that
are equal in tokens and close in attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.bpe import library_encoder
from factorloom.llm.common import Scratch, id_and_text, release_memory, text_blocks

#: Rests held by a task before it packs them, so that gaps find good fits.
POOL = 2048
#: Tasks whose last rests are packed together.
TASKS_TOGETHER = 32
SECOND = 1 << 62
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_id", pa.int64()), ("task", pa.int32()), ("ids", pa.binary())])
PIECE_SPARK = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long, task int, ids binary"


@dataclass(order=True)
class Rest:
    """An unpacked run of a document's ids."""

    size: int
    order: int
    doc_id: int = field(compare=False)
    start: int = field(compare=False)
    doc_tokens: int = field(compare=False)
    ids: np.ndarray = field(compare=False)


class Packer:
    """Packs the rests it is given; out(window, pieces) receives each full window."""

    def __init__(self, tiers: tuple[int, ...], out: Callable[[int, list[Rest]], None]):
        self.tiers, self.out = tuple(sorted(tiers)), out
        self.pools: dict[int, list[Rest]] = {t: [] for t in self.tiers}
        self.held, self.order = dict.fromkeys(self.tiers, 0), 0

    def add(self, doc_id: int, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        whole = len(ids) // top * top
        for at in range(0, whole, top):
            self.out(top, [Rest(top, 0, doc_id, start + at, doc_tokens, ids[at : at + top])])
        if whole < len(ids):
            self._put(doc_id, start + whole, doc_tokens, ids[whole:])

    def _put(self, doc_id: int, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        self.order += 1
        tier = next(t for t in self.tiers if t >= len(ids))
        insort(self.pools[tier], Rest(len(ids), self.order, doc_id, start, doc_tokens, ids.copy()))
        self.held[tier] += len(ids)

    def waiting(self) -> int:
        return sum(map(len, self.pools.values()))

    def pack(self) -> None:
        """Fill windows from the longest tier down while the tokens for a window are there."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            while self.pools[tier] and sum(self.held[t] for t in self.tiers[: k + 1]) >= tier:
                self._window(k)

    def _take(self, k: int, most: int) -> Rest | None:
        """The longest rest of at most `most` ids in tiers up to k."""
        for t in reversed(self.tiers[: k + 1]):
            at = bisect_right(self.pools[t], most, key=lambda r: r.size)
            if at:
                rest = self.pools[t].pop(at - 1)
                self.held[t] -= rest.size
                return rest
        return None

    def _window(self, k: int) -> None:
        gap, inside = self.tiers[k], []
        while gap:
            rest = self._take(k, gap)
            if rest is None:  # all that is left is longer than the gap: cut the shortest
                tier = next(t for t in self.tiers[: k + 1] if self.pools[t])
                rest = self.pools[tier].pop(0)
                self.held[tier] -= rest.size
                self._put(rest.doc_id, rest.start + gap, rest.doc_tokens, rest.ids[gap:])
                rest = Rest(gap, rest.order, rest.doc_id, rest.start, rest.doc_tokens, rest.ids[:gap])
            inside.append(rest)
            gap -= rest.size
        self.out(self.tiers[k], inside)

    def rest(self) -> list[Rest]:
        return [r for t in reversed(self.tiers) for r in self.pools[t]]


class Steps:
    """Deals windows to open step groups: the one with the least attention cost that has room."""

    def __init__(self, first: int, budget: int, open_steps: int = 4):
        self.next, self.budget, self.steps = first, budget, []
        for _ in range(open_steps):
            self._open()

    def _open(self) -> None:
        self.steps.append([0, self.next, 0])
        self.next += 1

    def deal(self, window: int) -> int:
        fits = [s for s in self.steps if s[2] + window <= self.budget]
        if not fits:
            self.steps.remove(max(self.steps, key=lambda s: s[2]))
            self._open()
            fits = [self.steps[-1]]
        step = min(fits)
        step[0] += window * window
        step[2] += window
        if step[2] == self.budget:
            self.steps.remove(step)
            self._open()
        return step[1]


class Writer:
    """Collects the rows of full windows, and of rests that stay open."""

    def __init__(self, base: int, step_tokens: int):
        self.sequence, self.rows = base, []
        self.steps = Steps(base, step_tokens)

    def window(self, tier: int, inside: list[Rest]) -> None:
        offset, step = 0, self.steps.deal(tier)
        for r in inside:
            self.rows.append((r.doc_id, r.start, r.size, zlib.crc32(r.ids.tobytes()), r.doc_tokens, self.sequence, offset, tier, step, None, None))
            offset += r.size
        self.sequence += 1

    def open(self, r: Rest, task: int) -> None:
        self.rows.append((r.doc_id, r.start, r.size, None, r.doc_tokens, None, None, None, None, task, r.ids.tobytes()))

    def batches(self, least: int = 4096) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)
            self.rows = []


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), step_tokens: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    A document's ids are those of its text and end_id. All windows are full but the last of each
    TASKS_TOGETHER tasks, which the trainer pads to the longest tier. Ids are computed once and never
    shuffled, but for the few rests that tasks leave; numbering follows the tasks over the input's files,
    so it is the same when a task is repeated. Null and empty texts are the end_id alone; repeated rows are packed
    each; a null doc_id stays null; an empty table gives no rows; extra columns are ignored; memory holds POOL rests and a text.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out = Writer(task << 32, step_tokens)
        packer, machine, tail = Packer(tiers, out.window), library_encoder(path), np.array([end_id], "<u4").tobytes()
        release_memory()
        for doc_ids, texts in text_blocks(batches, 1024):
            for doc_id, encoded in zip(doc_ids, machine.encode_many(texts), strict=True):
                ids = np.frombuffer(encoded + tail, "<u4")
                packer.add(doc_id, 0, len(ids), ids)
                if packer.waiting() >= POOL:
                    packer.pack()
                yield from out.batches()
        packer.pack()
        for r in packer.rest():
            out.open(r, task)
        yield from out.batches(1)
        machine.rest()
        release_memory()

    def second(key: tuple, table: pa.Table) -> pa.Table:
        out = Writer(SECOND | key[0].as_py() << 32, step_tokens)
        packer = Packer(tiers, out.window)
        rows = sorted(table.select(["task", "doc_id", "start", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (r["task"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        for r in rows:
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
        packer.pack()
        last, room = [], tiers[-1]
        for r in packer.rest():  # less than a window of each tier is left: pad as few sequences as can be
            if r.size > room:
                out.window(max(tiers), last)
                last, room = [], tiers[-1]
            last.append(r)
            room -= r.size
        if last:
            out.window(max(tiers), last)
        return pa.Table.from_batches(list(out.batches(1)), PIECE)

    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(id_and_text(docs, id_col, text_col).mapInArrow(first, PIECE_SPARK), "pieces")
    together = pieces.where("task is not null").withColumn("grp", F.floor(F.col("task") / TASKS_TOGETHER)).groupBy("grp").applyInArrow(second, PIECE_SPARK)
    return pieces.where("task is null").unionByName(together).drop("task", "ids")
