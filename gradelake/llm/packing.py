"""Best-fit packing by a linear grouping scheme (Fernandez de la Vega and Lueker, 1981; Gilmore and Gomory, 1961).

Everything about a packing follows from how many pieces there are of each length, at most `capacity` numbers. From these the driver rounds large
lengths up within groups of equal cardinality, finds the best mix of configurations of the few sizes by column generation, puts actual lengths in the
places, and best-fits the rest and the small ones. The plan is a short table of runs; each piece finds its place from its length and its rank
among the pieces of that length, which Spark computes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.bpe import Encoded, with_tokens
from gradelake.llm.common import cut


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut after every `capacity` ids: id, piece, start, length, ids_crc32. A null text counts as empty (one id)."""
    kind, end = docs.schema[id_col].dataType.simpleString(), end_id.to_bytes(4, "little")

    def make(e: Encoded, b: pa.RecordBatch) -> pa.RecordBatch:
        ids, row, piece, length, crc = memoryview(e.ids().astype("<u4").tobytes()), [], [], [], []
        for i, (first, last) in enumerate(zip(e.ends.tolist(), e.ends[1:].tolist())):
            for k, at in enumerate(range(first, last + 1, capacity)):  # the end id stands at `last`
                to = min(at + capacity, last + 1)
                own = zlib.crc32(ids[4 * at : 4 * min(to, last)])
                row.append(i)
                piece.append(k)
                length.append(to - at)
                crc.append(zlib.crc32(end, own) if to > last else own)
        arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32"])

    return with_tokens(docs, path, [id_col], f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long", make, text_col)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """The linear programme over all configurations of a few sizes: (how many of each size, how often), by column generation.

    rounds bounds the pivots; what the mix leaves unpacked then is best-fitted like any rest.
    """
    n = len(sizes)
    basis = np.diag(np.minimum(capacity // sizes, np.maximum(demand, 1)).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i in np.flatnonzero(worth > 1e-9):
            w = int(sizes[i])
            for a in range(w, capacity + 1, w):
                b = min(a + w, capacity + 1)
                with_i = best[a - w : b - w] + worth[i]
                better = with_i > best[a:b] + 1e-12
                best[a:b][better] = with_i[better]
                took[a:b][better] = i
        if best[capacity] <= 1 + 1e-5:
            break
        column, room = np.zeros(n), capacity
        while room > 0 and took[room] >= 0:
            column[took[room]] += 1
            room -= int(sizes[took[room]])
        d = inverse @ column
        x = inverse @ demand
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse[out] /= d[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(d[others], inverse[out])
    x = inverse @ demand
    return [(basis[:, k].round().astype(int), float(x[k])) for k in range(n) if x[k] > 1e-9]


@dataclass
class Plan:
    """Runs: of each length, pieces ranked from..from+n-1 go per_bin to a sequence, from sequence `first` and place `offset` on."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, from, n, per_bin, first, offset
    bins: int = 0
    used: dict[int, int] = field(default_factory=dict)
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # gap -> (first, count)
    order: list[int] = field(default_factory=list)

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def put(self, length: int, first: int, count: int, per_bin: int, offset: int) -> None:
        start = self.used.get(length, 0)
        self.runs.append((length, start, count * per_bin, per_bin, first, offset))
        self.used[length] = start + count * per_bin

    def leave(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not self.gaps.get(gap):
                insort(self.order, gap)
                self.gaps[gap] = []
            self.gaps[gap].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """count pieces of one length, each to the fullest sequence that has room, else to a new one."""
        while count:
            k = bisect_left(self.order, length)
            if k < len(self.order):
                gap = self.order[k]
                first, room = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.order[k]
            else:
                gap, room = self.capacity, -(-count // (self.capacity // length))
                first = self.open(room)
            per_bin = min(gap // length, count)
            full = min(room, count // per_bin)
            self.put(length, first, full, per_bin, self.capacity - gap)
            count -= full * per_bin
            self.leave(gap - per_bin * length, first, full)
            self.leave(gap, first + full, room - full)


def draw(queue: list[list[int]], n: int) -> list[list[int]]:
    """The first n of a queue of [length, count]."""
    out = []
    while n:
        take = min(n, queue[0][1])
        out.append([queue[0][0], take])
        queue[0][1] -= take
        if not queue[0][1]:
            queue.pop(0)
        n -= take
    return out


def plan(counts: dict[int, int], capacity: int, groups: int = 200, small: float = 1 / 4, share: float = 1 / 8) -> Plan:
    """counts: pieces by length, 1 to capacity. groups: rounded sizes at most. Pieces are small up to the greatest length that is no more than `small`
    of the capacity and leaves no more than `share` of all ids to small pieces: they are kept to fill what rounding leaves open."""
    p, left = Plan(capacity), dict(counts)
    if n := left.pop(capacity, 0):
        p.put(capacity, p.open(n), n, 1, 0)
    ids, within, limit = sum(length * c for length, c in left.items()), 0, 0
    for length in sorted(left):
        within += length * left[length]
        if length > small * capacity or within > share * ids:
            break
        limit = length
    large = [(length, left[length]) for length in sorted(left, reverse=True) if length > limit]
    total = sum(c for _, c in large)
    if total:
        k = min(groups, total)
        cut_up: list[list[list[int]]] = [[] for _ in range(k)]  # of each group: [length, count], largest first
        seen = 0
        for length, c in large:
            while c:
                g = seen * k // total
                take = min(c, -(-(g + 1) * total // k) - seen)
                cut_up[g].append([length, take])
                c, seen = c - take, seen + take
        queues: list[list[list[int]]] = []
        for q in filter(None, cut_up):
            if queues and queues[-1][0][0] == q[0][0]:
                queues[-1] += q
            else:
                queues.append(q)
        sizes = np.array([q[0][0] for q in queues])  # rounded up to the group's largest
        demand = np.array([sum(c for _, c in q) for q in queues], float)
        for config, often in configurations(sizes, demand, capacity):
            copies = int(min([often + 1e-6, *(sum(c for _, c in queues[i]) // config[i] for i in np.flatnonzero(config))]))
            places = [draw(queues[i], copies) for i in np.flatnonzero(config) for _ in range(config[i])] if copies else []
            while places and places[0]:
                step = min(place[0][1] for place in places)  # sequences whose places hold the same actual lengths
                first, offset = p.open(step), 0
                for place in places:
                    p.put(place[0][0], first, step, 1, offset)
                    offset += place[0][0]
                    place[0][1] -= step
                    if not place[0][1]:
                        place.pop(0)
                p.leave(capacity - offset, first, step)
        rest: dict[int, int] = {}
        for q in queues:
            for length, c in q:
                rest[length] = rest.get(length, 0) + c
    else:
        rest = {}
    for length in sorted({*rest, *left}, reverse=True):
        n = rest.get(length, 0) if length > limit else left[length]
        if n:
            p.best_fit(length, n)
    return p


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, groups: int = 200, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All pieces with sequence_id and offset: sequences of at most `capacity` ids, as few as the scheme finds, each filled without gaps from 0.

    Null and empty texts are one id long. Repeated rows are packed each. Nulls in other columns and further columns change nothing. An empty table gives no rows.
    Very long texts are cut into as many pieces as they need; pieces of one length tie, and are told apart by id, number and hash.
    The driver sees counts by length only (at most `capacity` numbers). Ranks among equal lengths are taken within salted parts of each length and shifted by
    the sizes of the parts before, so one length may hold any share of the pieces.
    """
    all_pieces = cut(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in all_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(counts, capacity, groups).runs)
    parts = max(64, min(65536, sum(counts.values()) // 20_000))
    salted = all_pieces.withColumn("part", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(shift, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("rank") + F.col("before"))
    table = np.array(runs, np.int64).reshape(-1, 6)
    step = int(max([0, *counts.values()])) + 1
    starts = table[:, 0] * step + table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            run = table[np.searchsorted(starts, b["length"].to_numpy() * step + b["rank"].to_numpy(), side="right") - 1]
            since = b["rank"].to_numpy() - run[:, 1]
            yield b.drop(columns="rank").assign(sequence_id=run[:, 4] + since // run[:, 3], offset=run[:, 5] + since % run[:, 3] * run[:, 0])

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select(*names, "rank").mapInPandas(place, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
