"""Exact removal of repeated substrings by sorting suffixes, deep-shallow (Manzini and Ferragina, 2004).

Sorting every suffix of a corpus moves each byte hundreds of times. Here suffixes start at anchors only: of every string of `width` bytes the gram (half as long) with
the least hash is its anchor, so equal strings have their anchor at the same place and meet in the group of that anchor. What a group holds are segments: all strings
of one anchor, with the bytes around it. Equal segments are one, with a count, and need no bytes at all. Where a group has different segments, their right-hand sides are
sorted: multikey quicksort orders them to a shallow depth past the anchor, then a blind trie orders those with a longer common prefix; runs of the order say which share how
many bytes to the right, and the left-hand sides of a run's members, sorted, how many to the left. Strings that lie in both are repeated.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import cut, drop, remove, shared_dir

BLOCK = 1 << 19
SHALLOW = 32
#: A place is one number: a string's start, its anchor's distance from there, and how many strings follow, in bits of this width.
PLACE = 12


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the texts: (index of the text, first string's start, number of strings, anchor's place, hash of the anchor)."""
    out: list[tuple[np.ndarray, ...]] = []
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), BLOCK):  # long texts in blocks that overlap by width - 1
            piece = t[at : at + BLOCK + width - 1]
            if len(piece) >= width:
                part.append((i, at, piece))
                size += len(piece)
            if size >= BLOCK:
                out.append(_block(part, width))
                part, size = [], 0
    if part:
        out.append(_block(part, width))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))  # type: ignore[return-value]


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` bytes: hashes of k bytes make hashes of 2k bytes, and those of the powers of two in size are put together."""
    h, k, have, out = data.astype(np.uint64) + np.uint64(1), 1, 0, np.zeros(len(data) + 1, np.uint64)
    while k <= size:
        if size & k:
            n = len(data) + 1 - have - k
            out = (out[:n] * np.uint64(0x94D049BB133111EB)) ^ h[have : have + n]
            out ^= out >> np.uint64(30)
            have += k
        if k * 2 <= size:
            h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
        k *= 2
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _block(part: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
    sizes = np.array([len(p) for _, _, p in part])
    ends, gram = np.cumsum(sizes), width // 2
    h = _gram_hashes(data, gram)
    bits = np.uint64(len(data).bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    span, had = width - gram + 1, 1
    while had * 2 <= span:
        least = np.minimum(least[:-had], least[had:])
        had *= 2
    if had < span:
        least = np.minimum(least[: len(h) - span + 1], least[span - had :])
    start = np.flatnonzero(np.arange(len(least)) + width <= np.repeat(ends, sizes)[: len(least)])
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(place) != 0)]) if len(start) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(start)])
    s0, a = start[first], place[first]
    own = np.searchsorted(ends, s0, side="right")
    shift = np.array([at for _, at, _ in part])[own] - (ends - sizes)[own]
    return np.array([i for i, _, _ in part])[own], s0 + shift, n, a + shift, h[a].view(np.int64)


def settled(texts: list[bytes], width: int, i: np.ndarray, s0: np.ndarray, n: np.ndarray, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Segments that occur again in their own text need no other to be repeated: which of them to leave out (all but the first), and the ranges of their
    strings, (text, first start, how many, hash of an anchor there). Periodic text, such as a long line of one character, is settled here: it has an anchor a period."""
    order = np.lexsort((s0, a - s0, n, h, i))
    same = np.flatnonzero(np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (i, h, n, a - s0)]))
    gone, copied = np.zeros(len(i), bool), np.zeros(len(i), bool)
    head, before = -1, -2
    for k in same.tolist():
        if k != before + 1:
            head = order[k]
        x, before = order[k + 1], k
        t, size = texts[i[x]], n[x] + width - 1
        if t[s0[x] : s0[x] + size] == t[s0[head] : s0[head] + size]:
            gone[x] = copied[x] = copied[head] = True
    own = np.flatnonzero(copied)
    own = own[np.lexsort((s0[own], i[own]))]
    ranges: list[tuple[int, int, int, int]] = []
    for t, x, m, key in zip(i[own].tolist(), s0[own].tolist(), n[own].tolist(), h[own].tolist()):
        if ranges and ranges[-1][0] == t and x <= ranges[-1][1] + ranges[-1][2] and x + m - ranges[-1][1] < BLOCK:
            ranges[-1] = (t, ranges[-1][1], x + m - ranges[-1][1], key)
        else:
            ranges.append((t, x, m, key))
    return gone, ranges


def common(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def multikey(idx: list[int], keys: list[bytes], depth: int = 0, until: int = SHALLOW, step: int = 8) -> Iterator[tuple[int, list[int]]]:
    """Ternary quicksort by `step` bytes at a time, from a depth to which all are equal until another: in order, groups with (at least) a common prefix of the given depth."""
    todo = [(idx, depth)]
    while todo:
        idx, depth = todo.pop()
        if len(idx) < 2 or depth >= until:
            if idx:
                yield depth, idx
            continue
        pivot = keys[idx[len(idx) // 2]][depth : depth + step]
        less, equal, more = [], [], []
        for i in idx:
            w = keys[i][depth : depth + step]
            (equal if w == pivot else less if w < pivot else more).append(i)
        todo += [(more, depth), (equal, depth + len(pivot) if len(pivot) == step else until), (less, depth)]


def intervals(order: list[int], keys: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(common prefix, members in order) of every longest run of sorted keys that have a prefix in common which their neighbours have not."""
    open_: list[tuple[int, int]] = []
    for k, same in enumerate([*(common(keys[i], keys[j]) for i, j in zip(order, order[1:])), -1]):
        first = k
        while open_ and open_[-1][0] > same:
            depth, first = open_.pop()
            yield depth, order[first : k + 1]
        if not open_ or open_[-1][0] < same:
            open_.append((same, first))


class BlindTrie:
    """Orders strings by their branching bytes alone; a node is [depth, {byte: child}], a leaf the list of the equal strings' indexes."""

    def __init__(self, keys: list[bytes]) -> None:
        self.keys, self.root = keys, None

    def add(self, i: int) -> None:
        s, node = self.keys[i], self.root
        if node is None:
            self.root = [i]
            return
        while isinstance(node, tuple):  # blind: only branching bytes are looked at
            node = node[1].get(self._at(s, node[0])) or next(iter(node[1].values()))
        other = self.keys[node[0]]
        same = common(s, other)
        above, edge, node = None, None, self.root
        while isinstance(node, tuple) and node[0] <= same:
            if node[0] == same and self._at(s, same) not in node[1]:
                node[1][self._at(s, same)] = [i]
                return
            above, edge = node, self._at(s, node[0])
            node = node[1][edge]
        if not isinstance(node, tuple) and same == len(s) == len(other):
            node.append(i)
            return
        new = (same, {self._at(other, same): node, self._at(s, same): [i]})
        if above is None:
            self.root = new
        else:
            above[1][edge] = new

    @staticmethod
    def _at(s: bytes, k: int) -> int:
        return s[k] if k < len(s) else -1

    def order(self) -> list[int]:
        """All strings' indexes in order."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def repeated(segments: list[tuple[int, bytes]], width: int) -> list[list[tuple[int, int]]]:
    """For segments of one anchor, each (anchor's place in it, bytes): the ranges [from, to) of its strings that are in another one, too."""
    right = [b[a:] for a, b in segments]
    left = [b[:a][::-1] for a, b in segments]
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    gram, order = right[0][: width // 2], []
    shallow = len(gram) if all(r.startswith(gram) for r in right) else 0  # anchors of one hash are one gram, in which there is nothing to sort
    for _, group in multikey(list(range(len(segments))), right, shallow, shallow + SHALLOW):
        trie = BlindTrie(right)
        for i in group:
            trie.add(i)
        order += trie.order()
    for shared, members in intervals(order, right):
        inner = sorted(members, key=left.__getitem__)
        near = [common(left[i], left[j]) for i, j in zip(inner, inner[1:])]
        for i, before, after in zip(inner, [0, *near], [*near, 0]):
            a, to_left = segments[i][0], max(before, after)
            first, last = a - to_left, a + shared - width
            if last >= first:
                found[i].append((max(0, first), last + 1))
    return found


def _place(at: int) -> tuple[int, int, int]:
    """(first string's start, anchor's distance from it, number of strings) of a place."""
    low = (1 << PLACE) - 1
    return at >> 2 * PLACE, at >> PLACE & low, at & low


def _unite(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: so many texts are unpacked together."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _unpack(column: pa.Array) -> list[bytes]:
    get = zstandard.ZstdDecompressor().decompress
    return [get(z) for z in column.to_pylist()]


def remove_repeats(
    docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, most_in_group: int = 1024, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and with keep_text the kept text); carry names further columns to return.

    Each byte that lies in a string of `width` bytes which also starts anywhere else, in the same row or another, is removed; overlaps count and strings are
    judged on the input. Spans are maximal removed runs. Texts are UTF-8 bytes, null ones empty; texts shorter than width lose nothing; very long ones are read
    in overlapping blocks. Repeated rows are copies: all lose everything from width bytes on. Null ids change nothing, nor do further columns of any name. An empty
    table gives no rows. Kept text is decoded with U+FFFD where a cut splits a character.
    Equal texts are sorted once, equal segments are only counted. A group with more than most_in_group different segments (an edge of a passage that very many texts
    hold) would be too much for one task: it is not sorted; Spark deals and counts all of its strings of `width` bytes by 128-bit keys instead. Any share of the
    rows may fall in one group, and the result does not depend on most_in_group.
    """
    if not 32 <= width < 1 << PLACE:
        raise ValueError(f"width must be at least 32 and less than {1 << PLACE}")
    spark = docs.sparkSession
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), *carry, F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = zstandard.ZstdCompressor(level=3).compress
        for b in _slices(batches):
            raw = [t.encode() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in raw], pa.int64()), pa.array(list(map(put, raw)), pa.binary())], ["k1", "k2", "n_bytes", "z"])

    # one row a distinct text, compressed once and dealt by its key into files: later joins find it there without moving it again
    texts = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("t")).mapInArrow(packed, "k1 long, k2 long, n_bytes long, z binary")
    texts = texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("z").alias("z"))
    name = f"texts_{uuid.uuid4().hex}"  # as many files as the aggregation has partitions: each task writes those it holds
    path = f"{shared_dir(spark)}/{name}"
    texts.write.bucketBy(n_files, "k1", "k2").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    texts = spark.table(name)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(_unpack(b.column(0)), width)[4])], ["h"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by place; of those that their own text settles, the ranges, as numbers below 0."""
        for b in _slices(batches):
            raw = _unpack(b.column(2))
            i, s0, n, a, h = anchors(raw, width)
            gone, ranges = settled(raw, width, i, s0, n, a, h)
            of, start, count, key = np.array(ranges, np.int64).reshape(-1, 4).T
            own, at = pa.array(np.r_[i[~gone], of]), np.r_[((s0 << PLACE | (a - s0)) << PLACE | n)[~gone], ~(start << 2 * PLACE | count)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[h[~gone], key]), b.column(0).take(own), b.column(1).take(own), pa.array(at)], ["h", "k1", "k2", "at"])

    long_enough = texts.where(F.col("n_bytes") >= width)
    often = cut(long_enough.select("z").mapInArrow(hashes, "h long").groupBy("h").count().where("count > 1").select(F.col("h").alias("r")), "repeated-anchors")
    where = long_enough.select("k1", "k2", "z").mapInArrow(places, "h long, k1 long, k2 long, at long").join(often, F.col("h") == F.col("r"), "left_semi")
    where = where.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "at")).alias("places"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each segment with a 128-bit signature of its bytes and its anchor's place in them."""
        for b in _slices(batches):
            for k1, k2, z, some in zip(*(c.to_pylist() for c in b.columns)):
                t = zstandard.ZstdDecompressor().decompress(z)
                h, at, sign = [p["h"] for p in some], [p["at"] for p in some], []
                for x in at:
                    start, a, n = _place(x) if x >= 0 else (0, 0, 0)
                    sign.append(hashlib.blake2b(b"%d:" % a + t[start : start + n + width - 1], digest_size=16).digest() if x >= 0 else bytes(16))
                s = np.frombuffer(b"".join(sign), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array([k1] * len(h), pa.int64()), pa.array([k2] * len(h), pa.int64()), pa.array(at, pa.int64())], ["h", "s1", "s2", "k1", "k2", "at"])

    found = cut(texts.select("k1", "k2", "z").join(where, ["k1", "k2"]).select("k1", "k2", "z", "places").mapInArrow(signed, "h long, s1 long, s2 long, k1 long, k2 long, at long"), "segments")
    drop(often)
    distinct = found.where("at >= 0").groupBy("h", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    distinct = cut(distinct.select("h", "s1", "s2", "n", "one.*"), "distinct-segments")
    sizes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("h", "g")
    needed = distinct.join(sizes, F.col("h") == F.col("g")).groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "s1", "s2", "at", "m")).alias("segments"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of one segment of each kind, where its group has others."""
        for b in _slices(batches):
            for z, some in zip(*(c.to_pylist() for c in b.columns)):
                t, kind = zstandard.ZstdDecompressor().decompress(z), {"h": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "m": pa.int64()}
                at = [_place(p["at"]) for p in some]
                body = [t[start : start + n + width - 1] for start, _, n in at]
                arrays = [pa.array([p[c] for p in some], k) for c, k in kind.items()]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([a for _, a, _ in at], pa.int32()), pa.array(body, pa.binary())], [*kind, "a", "body"])

    grouped = cut(texts.select("k1", "k2", "z").join(needed, ["k1", "k2"]).select("z", "segments").mapInArrow(bodies, "h long, s1 long, s2 long, m long, a int, body binary"), "bodies")
    result = "s1 long, s2 long, ranges array<struct<from: int, to: int>>"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by anchor; a group may reach over batches."""

        def solve(group: list[dict]) -> list[dict]:
            ranges = repeated([(r["a"], r["body"]) for r in group], width)
            return [{"s1": r["s1"], "s2": r["s2"], "ranges": [{"from": x, "to": y} for x, y in _unite(own)]} for r, own in zip(group, ranges) if own]

        kind = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("ranges", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])
        group: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if group and group[0]["h"] != r["h"]:
                    out += solve(group)
                    group = []
                group.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        yield pa.RecordBatch.from_pylist(solve(group) if group else [], schema=kind)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for r in b.to_pylist():
                n = len(r["body"]) - width + 1
                signs = np.frombuffer(b"".join(hashlib.blake2b(r["body"][k : k + width], digest_size=16).digest() for k in range(n)), np.int64).reshape(n, 2)
                own = [pa.array([r[c]] * n, pa.int64()) for c in ("s1", "s2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(n, dtype=np.int32)), pa.array(signs[:, 0]), pa.array(signs[:, 1])], ["s1", "s2", "k", "w1", "w2"])

    small = grouped.where(F.col("m") <= most_in_group).select("h", "s1", "s2", "a", "body").repartition("h").sortWithinPartitions("h").mapInArrow(sort, result)
    strings = grouped.where(F.col("m") > most_in_group).select("s1", "s2", "body").mapInArrow(windows, "s1 long, s2 long, k int, w1 long, w2 long")
    again = cut(strings.groupBy("w1", "w2").count().where("count > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2")), "strings")
    large = strings.join(again, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")), "left_semi").groupBy("s1", "s2").agg(F.collect_set(F.struct(F.col("k").alias("from"), (F.col("k") + 1).alias("to"))).alias("ranges"))
    strings_in = F.col("at").bitwiseAND((1 << PLACE) - 1).cast("int")
    whole = lambda n: F.array(F.struct(F.lit(0).alias("from"), n.alias("to")))
    copied = distinct.where("n > 1").select("s1", "s2", whole(strings_in).alias("ranges"))
    marks = cut(copied.unionByName(small).unionByName(large).withColumnsRenamed({"s1": "m1", "s2": "m2"}), "marks")
    drop(distinct, grouped, again)
    start = lambda at: F.shiftright(at, 2 * PLACE)
    hit = found.where("at >= 0").select("s1", "s2", "k1", "k2", start(F.col("at")).alias("s0")).join(marks, (F.col("s1") == F.col("m1")) & (F.col("s2") == F.col("m2"))).select("k1", "k2", "s0", "ranges")
    alone = F.bitwise_not("at")
    hit = hit.unionByName(found.where("at < 0").select("k1", "k2", start(alone).alias("s0"), whole(alone.bitwiseAND((1 << 2 * PLACE) - 1).cast("int")).alias("ranges")))
    hit = hit.groupBy("k1", "k2").agg(F.collect_list(F.struct("s0", "ranges")).alias("hits"))
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text

    def spans(hits: pa.ListArray, sizes: np.ndarray, copies: np.ndarray) -> list[list[tuple[int, int]]]:
        """Of each text the united byte ranges of its hits; all of it if there are copies of it."""
        base = np.cumsum(np.r_[0, sizes[:-1] + 1])  # all texts on one line, so that one sort unites all ranges
        row = np.repeat(np.arange(len(sizes)), np.nan_to_num(pc.list_value_length(hits).to_numpy(zero_copy_only=False).astype(float)).astype(int))
        each, whole = hits.flatten(), np.flatnonzero((copies > 1) & (sizes >= width))
        ranges = each.field("ranges")
        at = np.repeat(base[row] + each.field("s0").to_numpy(zero_copy_only=False), pc.list_value_length(ranges).to_numpy(zero_copy_only=False))
        flat = ranges.flatten()
        start = np.r_[at + flat.field("from").to_numpy(zero_copy_only=False), base[whole]]
        end = np.r_[at + flat.field("to").to_numpy(zero_copy_only=False) + width - 1, base[whole] + sizes[whole]]
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(start) else np.zeros(0, np.int64)
        a, b = start[new], end[np.r_[new[1:] - 1, len(end) - 1]] if len(new) else end
        of = np.searchsorted(base, a, side="right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in sizes]
        for i, x, y in zip(of.tolist(), (a - base[of]).tolist(), (b - base[of]).tolist()):
            out[i].append((x, y))
        return out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            removed, n_spans, sha, kept_texts = [], [], [], []
            sizes = b.column(3).to_numpy(zero_copy_only=False)
            for gone, size, z in zip(spans(b.column(5), sizes, b.column(2).to_numpy(zero_copy_only=False)), sizes.tolist(), b.column(4).to_pylist()):
                t = zstandard.ZstdDecompressor().decompress(z)
                kept = b"".join([t[x:y] for x, y in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), size])]) if gone else t
                removed.append(size - len(kept))
                n_spans.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode(errors="replace"))
            arrays = [b.column(0), b.column(1), b.column(3), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays, names = [*arrays, pa.array(kept_texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    done = cut(texts.join(hit, ["k1", "k2"], "left").select("k1", "k2", "n", "n_bytes", "z", "hits").mapInArrow(finish, schema), "kept")
    drop(found, marks)
    spark.sql(f"drop table {name}")
    remove(spark, path)
    out = rows.join(done, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")))
    return out.select(id_col, *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
