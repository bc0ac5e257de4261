"""Near-dedup by Order MinHash (Marcais et al., 2019): sketches that keep the order of minimum k-mers, then banded alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import components, cut, drop

BINS = 32
#: Pairs of texts of so many k-mers at most are found without sketches: minima drawn from few k-mers agree less often than J^minima.
SHORT = 80
#: Cells in which items are counted for an order of rarity: 4 MB, however many items there are.
CELLS = 1 << 20


def grams(words: list[str], k: int = 5) -> np.ndarray:
    """The k-mers of a sequence of words as 64 bits each, labelled by occurrence, in text order. Sequences shorter than k words are one k-mer; without words there are none."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < k:
        w = np.append(w, np.full(k - len(w), 7, np.uint64))
    x = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x += w[i : len(w) - k + 1 + i]
    order = np.argsort(x, kind="stable")  # a k-mer met again is another one: it is labelled by how often it came before
    same = np.r_[False, x[order][1:] == x[order][:-1]]
    if same.any():
        run = np.arange(len(x)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
        x[order] += run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x


def sketches(words: list[str], k: int = 5, n_sketches: int = 20, minima: int = 5) -> list[int]:
    """n_sketches signed 64-bit sketches of a sequence of words."""
    return sketches_of(grams(words, k), n_sketches, minima)


def sketches_of(x: np.ndarray, n_sketches: int = 20, minima: int = 5) -> list[int]:
    """The sketches of labelled k-mers; of none there are none."""
    if not len(x):
        return []
    seeds = np.arange(1, n_sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    h = x[None] ^ seeds[:, None]
    h *= np.uint64(0xE7037ED1A0B428DB)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x8EBC6AF09C88C6E3)
    if len(x) > minima:
        least = np.sort(np.argpartition(h, minima - 1, axis=1)[:, :minima], axis=1)  # back in text order
    else:
        least = np.tile(np.arange(len(x)), (n_sketches, 1))
    out = seeds.copy()
    for i in range(least.shape[1]):
        out = (out ^ x[least[:, i]]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return out.view(np.int64).tolist()


def bins(words: list[str]) -> list[int]:
    """Words counted in BINS bins: half the L1 distance of two such counts is no more than the edit distance."""
    return np.bincount(np.fromiter((xxhash.xxh3_64_intdigest(w) % BINS for w in words), np.int64, len(words)), minlength=BINS).tolist()


def distance(a: list[str], b: list[str], limit: int) -> int | None:
    """Edit distance of two word sequences if at most limit, else None.

    Banded: only cells within limit of the diagonal are computed, as bits of one integer a column (Myers, 1999), the band moving down a block of columns at a time.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return max(n, m)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    block, first, last, top, plus, minus = max(256, limit), 0, 0, 0, 0, 0
    for j in range(0, m, block):
        to = min(m, j + block)
        new_first, new_last = max(0, min(n, j - limit)), min(n, to + limit)
        plus |= (1 << (new_last - first)) - (1 << (last - first))
        gone = (1 << (new_first - first)) - 1
        top += (plus & gone).bit_count() - (minus & gone).bit_count()
        plus, minus, first, last = plus >> (new_first - first), minus >> (new_first - first), new_first, new_last
        mask = (1 << (last - first)) - 1
        for w in b[j:to]:
            match = where.get(w, 0) >> first & mask
            x = match | minus
            d0 = ((plus + (x & plus)) ^ plus) | x
            right_less, right_more = plus & d0, minus | ~(plus | d0)
            x = right_more << 1 | 1
            minus = x & d0 & mask
            plus = (right_less << 1 | ~(x | d0)) & mask
            top += 1
    d = top + plus.bit_count() - minus.bit_count()
    return d if d <= limit else None


def bounded_distance(a: list[str], b: list[str], near: int, far: int) -> int | None:
    """Edit distance if at most far, else None; cheap when it is at most near, or when the words alone rule it out."""
    if abs(len(a) - len(b)) > far:
        return None
    kept = sum((Counter(a) & Counter(b)).values())
    if max(len(a), len(b)) - kept > far:
        return None
    for limit in (16, near, far):
        if limit <= far and (d := distance(a, b, limit)) is not None:
            return d
    return None


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " "))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, far: float) -> DataFrame:
    """pairs (a, b), each once, with their edit distance d where it is at most `far` of the longer text's words, and linked."""
    left = texts.select(F.col("c").alias("ca"), F.col("norm").alias("ta"))
    right = texts.select(F.col("c").alias("cb"), F.col("norm").alias("tb"))
    both = pairs.join(left, F.col("a") == F.col("ca")).select("a", "b", "ta").join(right, F.col("b") == F.col("cb")).select("a", "b", "ta", "tb")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked = [], []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = ta.split(" "), tb.split(" ")
                size = max(len(a), len(b))
                near = int((1 - similarity) * size + 1e-9)
                got = bounded_distance(a, b, near, max(near, int(far * size)))
                d.append(got)
                linked.append(got is not None and got <= near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.int32()), pa.array(linked)], ["a", "b", "d", "linked"])

    return cut(both.mapInArrow(align, "a string, b string, d int, linked boolean"), "aligned")


def _rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (c, item): of each set (c, items) the rarest items that a set with an overlap of at least similarity * n, n its size, must share one of (prefix filter).

    Sets of sizes p and q that have at least similarity * max(p, q) items in common meet in one item of these, whatever the order of rarity, if it is one for all.
    It is that of counts in CELLS cells of the items' hashes, a table of fixed size that goes to every task; items alone in their cell are left out.
    """
    items = sets.select("c", "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            counts += np.bincount(_cells(pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False)), minlength=CELLS)
        for k, own in enumerate(np.split(counts, 16)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "counts"])

    def total(key: tuple, group: pa.Table) -> pa.Table:
        added = np.minimum(sum(np.frombuffer(c.as_py(), np.int64) for c in group["counts"]), (1 << 31) - 1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([added.astype(np.int32).tobytes()], pa.binary())})

    often = np.zeros((16, CELLS // 16), np.int32)
    for r in items.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(total, "part int, counts binary").collect():
        often[r["part"]] = np.frombuffer(r["counts"], np.int32)
    often = often.ravel()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen = []
            for own in b.column(1):
                x = own.values.to_numpy()
                m = often[_cells(x)]
                first = np.lexsort((x, m))[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]
                chosen.append(x[first][m[first] > 1])
            of = pa.array(np.repeat(np.arange(len(chosen)), [len(x) for x in chosen]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(np.concatenate([*chosen, np.zeros(0, np.int64)]), pa.int64())], ["c", "item"])

    return items.mapInArrow(choose, "c string, item long")


def _cells(items: np.ndarray) -> np.ndarray:
    return ((items.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _words(body: DataFrame) -> DataFrame:
    """The words of texts (c, norm), each labelled by its occurrence, as sets of 64 bits: (c, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                items = [grams(t.split(" "), 1).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.list_(pa.int64()))], ["c", "items"])

    return body.select("c", "norm").mapInArrow(run, "c string, items array<long>")


def classes(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, n_sketches: int = 20, minima: int = 5, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: id, class_id (least id among the documents reachable by links), kept, text_class; carry names further columns to return.

    Texts are compared as lower-case words between white space. Two different texts are candidates if one of n_sketches sketches agrees: the `minima`
    least of their k-mers of words, each labelled by its occurrence, in text order. Candidates link if their edit distance is at most (1 - similarity) of the longer
    one's words. What is promised are pairs whose labelled k-mers have a Jaccard similarity J of `similarity` or more and whose edit distance links them: a sketch agrees
    with a chance near J^minima (minima are drawn without replacement), so at J = 0.8 a pair with a text of more than SHORT k-mers is missed with a chance under 0.0005
    (k = 5, the other defaults alike). Two texts of at most SHORT k-mers are candidates whenever J is that high, whatever their sketches: such pairs share one of their
    rarest k-mers (prefix filter), meet on it, and J is counted. Pairs of a lower J (more than some 3 % of the words changed here and there) link if a sketch agrees.
    Equal texts are one class without alignment. Empty and null texts are equal to each other and link with nothing else. Very long texts are read whole. Null ids come last:
    class_id is null where all ids of a class are null. kept marks the rows of the class's least id (of one text, if rows of different texts share that id); repeated rows
    of it are all kept. Further columns, whatever their names, change nothing. An empty table gives no rows.

    No bucket is expanded into pairs. All of a bucket are aligned with its least member; who does not link starts over with the least of those left, `rounds` times.
    Links past the leader are not lost: of a bucket in which somebody is neither linked with the leader nor too far from it to link with others, and of what is left
    after the rounds, texts meet again on words: those that link have `similarity` of their words in common, so they share one of their rarest (prefix filter). Pairs
    of one bucket that meet there, and that lengths and binned word counts leave possible, are aligned, too, unless links have joined them by then.
    """
    rows = docs.select(F.col(id_col), *carry, normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("c", F.lower(F.concat(F.lpad(F.hex(F.xxhash64("norm")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "norm")), 16, "0"))))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # few texts at a time are held as words
                b = whole.slice(at, 512)
                words = [t.split(" ") if t else [] for t in b.column(2).to_pylist()]
                of, drawn, few = pa.array([len(w) for w in words], pa.int32()), [], []
                for w in words:
                    x = grams(w, k)
                    drawn.append(sketches_of(x, n_sketches, minima))
                    few.append(x.view(np.int64).tolist() if len(x) <= SHORT else [])
                longs = pa.list_(pa.int64())
                arrays = [b.column(0), b.column(1), of, pa.array(drawn, longs), pa.array(few, longs), pa.array([bins(w) for w in words], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "c", "n_words", "sketches", "grams", "bins"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = rows.select(id_col, "c", "norm").mapInArrow(sketch, f"id {kind}, c string, n_words int, sketches array<long>, grams array<long>, bins array<int>")
    texts = cut(texts.groupBy("c").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"), F.first("grams").alias("grams"), F.first("bins").alias("bins")), "texts")
    members = texts.select(F.explode("sketches").alias("s"), "c")
    shared = cut(members.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("leader")).where("m > 1").select(F.col("s").alias("t"), "leader"), "buckets")
    bucket = cut(members.join(shared, F.col("s") == F.col("t")).select("s", "c", "leader"), "members")
    short = cut(texts.where(F.size("grams") > 0).select("c", F.col("grams").alias("items")), "short")
    first = cut(_rarest(short, similarity), "rarest")
    needed = cut(bucket.select("c").unionByName(first.select("c")).distinct().join(texts.select("c", "id", "n_words", "bins"), "c"), "needed")
    own = needed.select(F.col("c").alias("nc"), F.col("id").alias("nid"))
    body = cut(rows.select(id_col, "c", "norm").join(own, (F.col("c") == F.col("nc")) & F.col(id_col).eqNullSafe(F.col("nid"))).select("c", "norm").dropDuplicates(["c"]), "bodies")
    known_ids = cut(texts.select("c", "id"), "ids")
    drop(texts, shared)

    slack = 1 - similarity
    far = min(1.0, slack * (1 / similarity + 1 / similarity**2) + 0.01)  # beyond this from the leader, y links with no x linked with the leader
    left, known, crossed = bucket, None, []
    for _ in range(rounds):
        pairs = left.where("c <> leader").select(F.col("leader").alias("a"), F.col("c").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        got = _verified(cut(pairs, "pairs"), body, similarity, far)
        known = got if known is None else cut(known.unionByName(got), "known")
        tried = cut(left.where("c <> leader").join(known, (F.col("leader") == F.col("a")) & (F.col("c") == F.col("b"))).select("s", "leader", "c", "d", "linked"), "tried")
        crossed.append(tried)
        rest = cut(tried.where("not linked").select("s", "c"), "rest")
        head = rest.groupBy("s").agg(F.min("c").alias("leader")).withColumnRenamed("s", "t")
        left = cut(rest.join(head, F.col("s") == F.col("t")).select("s", "c", "leader"), "left")
        drop(rest)
    linked = cut(known.where("linked").select("a", "b"), "links")
    roots = cut(components(linked), "roots")  # whom links have already joined needs no further alignment
    drop(bucket)

    within = lambda a, b: F.abs(F.col(f"n{a}") - F.col(f"n{b}")) <= slack * F.greatest(f"n{a}", f"n{b}") + 1e-9
    apart = F.aggregate(F.zip_with("h1", "h2", lambda p, q: F.abs(p - q)), F.lit(0), lambda t, v: t + v)
    size = cut(needed.select(F.col("c").alias("sc"), "n_words", "bins").join(roots, F.col("sc") == F.col("node"), "left").select("sc", "n_words", "bins", F.coalesce("root", "sc").alias("root")), "sizes")
    sized = lambda df, k: df.join(size.withColumnsRenamed({"n_words": f"n{k}", "bins": f"h{k}", "root": f"r{k}"}), F.col("c") == F.col("sc")).drop("sc").withColumnRenamed("c", f"c{k}")
    possible = (F.col("r1") != F.col("r2")) & within(1, 2) & (apart <= 2 * (slack * F.greatest("n1", "n2") + 1e-9))

    # buckets where somebody is neither linked with the leader nor too far from it, and what is left: these texts meet on their rarest words
    near = [cut(t.where("not linked and d is not null").select("s", "leader", "c"), "near-misses") for t in crossed]
    led = [cut(t.where("linked").select("s", "leader", "c").join(y.select("s", "leader").distinct(), ["s", "leader"], "left_semi"), "led") for t, y in zip(crossed, near)]
    open_ = left.select("s", "c")
    for t in (*near, *led):
        open_ = open_.unionByName(t.select("s", "c"))
    met_buckets = cut(open_.distinct().groupBy("c").agg(F.collect_list("s").alias("in")), "open-buckets")  # of each text few: one a sketch at most
    worded = cut(_words(body.join(met_buckets.select("c"), "c", "left_semi")), "words")
    rare = cut(_rarest(worded, similarity).withColumnsRenamed({"c": "wc", "item": "w"}), "rarest-words")
    own = rare.groupBy("wc").agg(F.collect_list("w").alias("p")).join(met_buckets, F.col("wc") == F.col("c")).drop("wc")
    own = cut(sized(own, 1).join(rare, F.col("c1") == F.col("wc")).drop("wc"), "worded")
    other = own.withColumnsRenamed({"c1": "c2", "n1": "n2", "h1": "h2", "r1": "r2", "in": "in2", "p": "p2", "w": "w2"})
    once = F.col("w") == F.array_min(F.array_intersect("p", "p2"))  # the least word they meet on says it, not each
    pairs = own.join(other, (F.col("w") == F.col("w2")) & (F.col("c1") < F.col("c2")) & possible & F.arrays_overlap("in", "in2") & once).select("c1", "c2")
    x = cut(sized(first, 1), "rarest")  # k-mers that one set of linked texts has to itself have nothing to add
    apiece = x.groupBy(F.col("item").alias("ag")).agg(F.min("r1").alias("least"), F.max("r1").alias("most")).where("least <> most").select("ag")
    x = cut(x.join(apiece, F.col("item") == F.col("ag")).drop("ag"), "rarest")
    y = x.withColumnsRenamed({"item": "item2", "c1": "c2", "n1": "n2", "h1": "h2", "r1": "r2"})
    met = cut(x.join(y, (F.col("item") == F.col("item2")) & (F.col("c1") < F.col("c2")) & possible).select("c1", "c2").distinct(), "met")
    held = lambda i: short.select(F.col("c").alias(f"k{i}"), F.col("items").alias(f"g{i}"))
    both = F.size(F.array_intersect("g1", "g2"))
    met = met.join(held(1), F.col("c1") == F.col("k1")).join(held(2), F.col("c2") == F.col("k2")).where(both >= similarity * (F.size("g1") + F.size("g2") - both) - 1e-9)
    pairs = pairs.unionByName(met.select("c1", "c2"))
    pairs = pairs.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    last = _verified(cut(pairs, "pairs"), body, similarity, slack)
    more_links = last.where("linked").select("a", "b")
    drop(*crossed, *near, *led, left, known, rare, worded, own, met_buckets, first, short, body)

    if not more_links.isEmpty():
        roots = cut(components(linked.unionByName(more_links)), "roots")
    of = known_ids.join(roots, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    of = cut(of, "roots")
    least = cut(of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "c")).alias("least")).select(F.col("root").alias("r"), F.col("least.id").alias("class_id"), F.col("least.c").alias("least_c")), "least")
    known_as = cut(of.join(least, F.col("root") == F.col("r")).select(F.col("c").alias("kc"), "class_id", "least_c"), "classes")
    drop(of, least, known_ids, linked, needed, size, last)
    out = rows.drop("norm").join(known_as, F.col("c") == F.col("kc"))
    return out.select(id_col, *carry, "class_id", ((F.col("c") == F.col("least_c")) & F.col(id_col).eqNullSafe(F.col("class_id"))).alias("kept"), F.col("c").alias("text_class"))
