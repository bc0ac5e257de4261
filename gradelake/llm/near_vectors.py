"""Embedding near-dedup: an exact metric range join.

Cosine >= t between unit vectors is Euclidean distance <= r = sqrt(2 - 2t). A bounded sample of vectors serves as pivots;
a vector's home is the cell of its nearest pivot. If x has home i and y has home j and |x - y| <= r, the triangle inequality
(in its sharper half-space form) gives (|y - p_i|^2 - |y - p_j|^2) / (2 |p_i - p_j|) <= r, so y is copied into every cell where that
holds. Cells are split into blocks, and each pair of blocks is one tile that judges its pairs of vectors once: a vector goes to the tiles
of its own block with those of its own cell and of the cells that must see it, so copies grow with the blocks of a group and not with
the square of a cell. Pivots move work between tasks and never change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import components, cut

#: Rounding of sums over a few thousand doubles stays far below this; it only widens what is copied.
SLACK = 1e-9
#: So many rows of a tile are compared at once.
CHUNK = 1024


def _pivots(classes: DataFrame, n: int) -> np.ndarray:
    """n vectors (a bounded sample), normalised, in a fixed pseudo-random order of ids."""
    rows = classes.select("embedding").orderBy(F.xxhash64(F.col("rep"), F.lit(17)), "rep").limit(n).collect()
    dims = [len(r[0]) for r in rows]
    size = max(set(dims), key=dims.count) if dims else 0
    p = np.array([r[0] for r in rows if len(r[0]) == size], dtype=np.float64)
    return p / np.linalg.norm(p, axis=1, keepdims=True) if len(p) else np.zeros((0, 0))


def _unit(embeddings: pa.Array) -> np.ndarray:
    x = embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embeddings), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _joined(linked: np.ndarray, start: int, left: np.ndarray, right: np.ndarray) -> None:
    """Labels of the components between left and right rows (-1: alone), grown by a 0/1 matrix between the left rows from start and all right rows."""
    for i in np.flatnonzero(linked.any(axis=1)):
        js = np.flatnonzero(linked[i])
        old = np.unique(right[js])
        for k in old[old >= 0]:
            right[right == k] = start + i
            left[left == k] = start + i
        right[js] = left[start + i] = start + i


def _tiles(placed: DataFrame, tile: int) -> DataFrame:
    """Rows (label, rep, n, embedding, cells) once for each tile that must see them: tile (i, j), i <= j, of two blocks of a label, and
    whether the row is of block i (left)."""
    of_cell = placed.groupBy("label", F.col("cells")[0].alias("cell")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    of_label = cut(of_cell.groupBy(F.col("label").alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "blocks"))).alias("blocks")), "blocks")  # one entry a pivot
    block = lambda cell, k: F.shiftleft(cell.cast("long"), 32) + k
    home, blocks = F.col("cells")[0], F.col("blocks")
    blocks_of = lambda c: F.transform(F.sequence(F.lit(0), blocks[c] - 1), lambda k: block(c, k))
    seen = F.flatten(F.transform(F.filter("cells", lambda c: F.map_contains_key(blocks, c)), blocks_of))
    own = block(home, F.pmod(F.xxhash64("rep"), blocks[home]))
    each = placed.join(of_label, F.col("label") == F.col("l")).withColumn("own", own).withColumn("other", F.explode(seen))
    return each.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "rep", "n", "embedding")


def range_join(
    vectors: DataFrame, threshold: float = 0.93, per_pivot: int = 16384, max_pivots: int = 64, tile: int = 8192,
    id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label",
) -> DataFrame:
    """All rows of vectors with n_links, component_id and kept.

    Two rows link when their groups are equal and not null and their cosine, in double precision, is >= threshold.
    n_links counts the other rows linked directly; component_id is the least id reachable by links; kept marks id = component_id.
    A row links with nothing (n_links 0, its own component) if its vector is null, empty, zero or holds null or non-finite
    components, or its group or id is null (a null id gives null component_id and kept true). Vectors of different length do not link.
    Equal vectors of a group are one class that is joined once and counted with its size; repeated rows are rows of their class, and
    rows that share an id are one node. Other columns of the input, whatever their names, are not looked at.
    per_pivot, max_pivots: a pivot for so many classes of the largest group, up to a bound. tile: cells of more rows are joined as
    blocks of about so many.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(group_col).alias("label"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    usable = F.coalesce(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable")
    classes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    n_classes = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    pivots = _pivots(classes, max(1, min(max_pivots, -(-n_classes // per_pivot))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class with the cells that must see it; the first is its home."""
        between = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
        for b in batches:
            cells = [[0]] * b.num_rows
            whole = np.flatnonzero(pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False) == pivots.shape[1])
            if len(whole):
                x = _unit(b.column(3).take(pa.array(whole)))
                square = 2 - 2 * (x @ pivots.T)
                home = square.argmin(axis=1)
                least = square[np.arange(len(x)), home]
                near = square - least[:, None] <= 2 * radius * between[home] + SLACK
                for i, k in enumerate(whole):
                    cells[k] = [int(home[i]), *(int(c) for c in np.flatnonzero(near[i]) if c != home[i])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "rep", "embedding")}
    placed = cut(classes.select("label", "rep", "n", "embedding").mapInArrow(place, f"label {kinds['label']}, rep {kinds['rep']}, n long, embedding {kinds['embedding']}, cells array<int>"), "placed")
    tiled = _tiles(placed, tile)

    def join(g: pa.Table) -> pa.Table:
        """Of one tile: how many rows each class links with (a = b), and a spanning forest of the links (a <> b)."""
        g, out = g.combine_chunks(), []
        size, alone = pc.list_value_length(g["embedding"]), g["i"][0] == g["j"][0]  # alone: a block with itself
        for n in pc.unique(size).to_pylist():
            own = g.filter(pc.equal(size, n))
            a = own.filter(own["left"])
            b = a if alone else own.filter(pc.invert(own["left"]))
            if not len(a) or not len(b):
                continue
            x, ids_a = _unit(a["embedding"].combine_chunks()), a["rep"].to_numpy()
            y, ids_b = (x, ids_a) if alone else (_unit(b["embedding"].combine_chunks()), b["rep"].to_numpy())
            weight_a, weight_b = a["n"].to_numpy(), b["n"].to_numpy()
            left, right = np.full(len(x), -1), np.full(len(y), -1)
            links_a, links_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for start in range(0, len(x), CHUNK):  # the whole matrix of a tile would be large
                at = slice(start, start + CHUNK)
                linked = x[at] @ y.T >= threshold
                linked &= ids_a[at, None] != ids_b[None]
                links_a[at], links_b = linked @ weight_b, links_b + weight_a[at] @ linked
                _joined(linked, start, left, right)
            for ids, links in ((ids_a, links_a),) if alone else ((ids_a, links_a), (ids_b, links_b)):
                some = links > 0
                out.append((ids[some], ids[some], links[some]))
            label, ids = np.concatenate([left, right]), np.concatenate([ids_a, ids_b])
            for k in np.unique(label[label >= 0]):
                members = np.unique(ids[label == k])
                out.append((members[1:], np.repeat(members[:1], len(members) - 1), np.zeros(len(members) - 1, np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        kind = g.schema.field("rep").type
        return pa.table({"a": pa.array(columns[0]).cast(kind), "b": pa.array(columns[1]).cast(kind), "links": pa.array(columns[2], pa.int64())})

    found = cut(tiled.groupBy("label", "i", "j").applyInArrow(join, f"a {kinds['rep']}, b {kinds['rep']}, links long"), "links")
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "r")
    roots = components(found.where("a <> b").select("a", "b"))
    known = cut(
        classes.join(links, F.col("rep") == F.col("r"), "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")),
        "known",
    )
    joined = rows.where("usable").join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
