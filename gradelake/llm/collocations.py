"""Phrases whose words stand together more often than their parts would: n-grams from an FM-index per shard.

A shard holds the words of some documents of one language as numbers, 0 between pieces. Its rotations are sorted by their
first MOST_WORDS words; the Burrows-Wheeler transform of that order and the counts of the words are its index. Rows that
begin with the same k words are an interval. All intervals of a depth are extended together: to the left by the word in
the transform (the LF step takes an interval's rows to those that begin with that word), to the right by the next word
within the interval. As no phrase is longer than what is sorted by, one index serves both directions.

Counts are summed over shards, and depth follows depth: an n-gram is reported by a shard only if the n-1 words it begins
with and the n-1 words it ends with are frequent over all shards. Frequent n-grams get numbers, by which one depth refers
to the one before: an n-gram is the pair of its beginning (which it extends to the right) and its end (to the left).
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.common import cut, drop

#: Phrases have two to so many words.
MOST_WORDS = 5
#: Words, or what parts pieces.
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r][ \t.,;:!?\n-\r]*")
#: A shard is closed when it has so many words, or when all open shards of a task have ALL_OPEN.
SHARD_WORDS, ALL_OPEN = 1_500_000, 6_000_000
#: Candidates of a language are ranked in so many groups first, then the first ones of each together.
SALTS = 64

#: A shard's number is its task's and its own within the task; an n-gram's place in a shard is its interval there.
#: (shard << PLACE_BITS) + place names an n-gram in a shard.
OWN_BITS, PLACE_BITS = 15, 28
SHARD = "shard long, lang string, total long, bwt binary, words array<string>, counts array<long>"


def index(symbols: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of numbers, 0 to the greatest all present, whose rotations are sorted by their first
    MOST_WORDS numbers; rotations that begin alike stay in the order of the text."""
    rank, depth = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while depth < MOST_WORDS:  # from ranks by depth numbers to ranks by twice as many, as far as needed
        step = min(depth, MOST_WORDS - depth)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = np.r_[False, np.diff(key[order]) != 0]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        depth += step
    return symbols[order - 1].astype(np.uint32)


class Intervals:
    """The intervals of an index at depth 1; deeper() goes on to the next depth."""

    def __init__(self, bwt: np.ndarray) -> None:
        self.first = np.sort(bwt)  # what each row begins with
        self.after = np.argsort(bwt, kind="stable")  # the row of each row's rest: the LF step backwards
        self.of = self.first  # the interval of each row; they are numbered in order
        self.starts = np.flatnonzero(np.r_[True, np.diff(self.first) != 0])

    def sizes(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.of)])

    def deeper(self) -> tuple[np.ndarray, np.ndarray]:
        """Extend all intervals by a word; returns of each new one the interval it begins with and the one it ends with."""
        rest = self.of[self.after]
        change = np.r_[True, (self.first[1:] != self.first[:-1]) | (rest[1:] != rest[:-1])]
        starts = np.flatnonzero(change)
        sides = self.of[starts], rest[starts]
        self.of, self.starts = np.cumsum(change) - 1, starts
        return sides


class Open:
    """Words of a language that become a shard."""

    def __init__(self, lang: str) -> None:
        self.lang, self.number, self.symbols = lang, defaultdict(lambda: len(self.number) + 1), [0]

    def add(self, text: bytes) -> int:
        number, before = self.number, len(self.symbols)
        self.symbols += [0 if t[0] < 64 and t[:1] in b".,;:!?\n\v\f\r" else number[t] for t in TOKEN.findall(text)]
        self.symbols.append(0)
        return len(self.symbols) - before

    def close(self, shard: int) -> dict[str, list]:
        symbols = np.array(self.symbols, np.uint32)
        if len(symbols) >> PLACE_BITS:
            raise ValueError(f"a text of {len(symbols)} words is too long for a shard")
        counts = np.bincount(symbols, minlength=len(self.number) + 1)[1:]
        return {
            "shard": [shard], "lang": [self.lang], "total": [int(counts.sum())],
            "bwt": [index(symbols).tobytes()], "words": [[w.decode() for w in self.number]], "counts": [counts.tolist()],
        }


def shards(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """SHARD rows: of each task and language, the index and the words, numbered from 1, of each so many words of text."""
    schema = pa.schema([
        ("shard", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("bwt", pa.binary()),
        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Open] = {}
        held, number = 0, itertools.count(TaskContext.get().partitionId() << OWN_BITS)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text.as_py():
                    own = opened.setdefault(lang, Open(lang))
                    held += own.add(text.as_buffer().to_pybytes().lower())  # of bytes, lower() changes A to Z alone
                    if len(own.symbols) > SHARD_WORDS or held > ALL_OPEN:
                        largest = max(opened.values(), key=lambda o: len(o.symbols))
                        held -= len(largest.symbols) - 1
                        yield pa.RecordBatch.from_pydict(opened.pop(largest.lang).close(next(number)), schema)
        while opened:
            yield pa.RecordBatch.from_pydict(opened.popitem()[1].close(next(number)), schema)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, SHARD)


def found(indexes: DataFrame, places: DataFrame, depth: int) -> DataFrame:
    """Rows (a, b, n, at) of the n-grams of this depth whose beginning a and end b are among places (at, id): the frequent
    n-grams one shorter. One row for each n-gram and shard, in which it is at."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        intervals = Intervals(np.frombuffer(left.column("bwt")[0].as_buffer(), np.uint32))
        for _ in range(depth - 2):
            intervals.deeper()
        known = np.full(len(intervals.starts), -1)
        known[right.column("at").to_numpy() & ((1 << PLACE_BITS) - 1)] = right.column("id").to_numpy()
        a, b = (known[side] for side in intervals.deeper())
        place = np.flatnonzero((a >= 0) & (b >= 0))
        at = place + (key[0].as_py() << PLACE_BITS)
        return pa.table({"a": a[place], "b": b[place], "n": intervals.sizes()[place], "at": at})

    places = places.select("at", "id", F.shiftright("at", PLACE_BITS).alias("of"))
    return indexes.groupBy("shard").cogroup(places.groupBy("of")).applyInArrow(run, "a long, b long, n long, at long")


def frequent(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """Of rows (by..., n, at) those whose n add up to the least number over all shards, with the sum as n and id, the least
    at of equal ones. A group has one row for each shard at most; it is sorted and read twice, and may be spilled."""
    same = Window.partitionBy(*by)
    summed = rows.withColumns({"n": F.sum("n").over(same), "id": F.min("at").over(same)})
    return cut(summed.where(F.col("n") >= least), "frequent")


def phrases(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The frequent n-grams of one to MOST_WORDS words, and the number of all words (lang, n_words).

    The n-grams: lang, words array, n long, starts and ends array<long>: the counts of its first and last 1, 2, ... words,
    itself the last; extended boolean: whether an n-gram with one word more, to the left or to the right, is as frequent.
    """
    indexes = cut(shards(docs, lang_col, text_col), "shards")
    total = cut(indexes.groupBy("lang").agg(F.sum("total").alias("n_words")), "totals")
    words = indexes.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    at = F.shiftleft("shard", PLACE_BITS) + F.col("place") + 1
    rows = frequent(words.select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), at.alias("at")), least, "lang", "word")
    once = rows.where("at = id")
    level = cut(once.selectExpr("id", "lang", "array(word) words", "n", "array(n) starts", "array(n) ends"), "phrases")
    levels = [level]
    for depth in range(2, MOST_WORDS + 1):
        before, last = rows, levels[-1]
        rows = frequent(found(indexes.select("shard", "bwt"), before.select("at", "id"), depth), least, "a", "b")
        drop(before)
        left = last.selectExpr("id a", "lang", "words words_a", "starts")
        right = last.selectExpr("id b", "words words_b", "ends")
        level = rows.where("at = id").join(left, "a").join(right, "b").selectExpr(
            "id", "lang", "concat(words_a, slice(words_b, -1, 1)) words", "n",
            "concat(starts, array(n)) starts", "concat(ends, array(n)) ends", "a", "b",
        )
        levels.append(cut(level, "phrases"))
    drop(indexes, rows)
    out = []
    for level, longer in zip(levels, [*levels[1:], None]):
        plain = level.select("id", "lang", "words", "n", "starts", "ends")
        if longer is None:
            out.append(plain.withColumn("extended", F.lit(False)))
            continue
        k = longer.select(F.explode(F.expr("""filter(array(
            if(starts[size(starts) - 2] = n, a, null), if(ends[size(ends) - 2] = n, b, null)), x -> x is not null)""")).alias("id"))
        out.append(plain.join(k.distinct().withColumn("extended", F.lit(True)), "id", "left").fillna(False, ["extended"]))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.drop("id"), total


def collocations(
    docs: DataFrame, least: int = 100, first: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """Per language the first phrases of two to five words by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences of the phrase, at least the given number; n: of all words. A cut into two parts that occur l and r
    times gives floor(1000 a n / (l r)); the least counts, of equal ones that with the shorter first part. Phrases within
    one of a word more that occurs as often are left out. Ties of score and a rank by phrase, in the order of UTF-8.

    A null language is "und"; null and empty texts hold no words, and a language without a phrase gives no rows. Rows that
    repeat count each; ids and other columns, null or of any name, are not looked at. Very long texts are taken whole: a
    shard is closed between texts, so that the longest text bounds its size. An empty table gives no rows.
    """
    every, total = phrases(docs, least, lang_col, text_col)
    whole = "decimal(38, 0)"
    scored = every.where("size(words) > 1 and not extended").join(total, "lang").selectExpr(
        "lang", "concat_ws(' ', words) phrase", "n a", "n_words",
        f"""array_min(transform(sequence(1, size(words) - 1), k -> struct(
            cast(cast(1000 as {whole}) * cast(n as decimal(19, 0)) * cast(n_words as decimal(19, 0)) as {whole})
                div (cast(starts[k - 1] as decimal(19, 0)) * cast(ends[size(words) - k - 1] as decimal(19, 0))) as score,
            k, starts[k - 1] as l, ends[size(words) - k - 1] as r))) best""",
    )
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", F.col("n_words").alias("n"), "best.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.where(F.col("rank") <= first).drop("salt", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql() -> str:
    """The same in SQL."""
    grams = " union all ".join(
        f"""select lang, list_value({', '.join(f'w{i}' for i in range(k))}) g from wide where w{k - 1} is not null"""
        for k in range(1, MOST_WORDS + 1)
    )
    # a gram never crosses pieces: the window over a piece is null past its end
    wide = ", ".join(f"lead(w, {i}) over p w{i}" for i in range(1, MOST_WORDS))
    return rf"""
with d as (select row_number() over () d, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
piece as (select d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) i from d),
word as (select d, i, lang, unnest(regexp_extract_all(p, '[^\x20\x09]+')) w, generate_subscripts(regexp_extract_all(p, '[^\x20\x09]+'), 1) j from piece),
wide as (select lang, w w0, {wide} from word window p as (partition by d, i order by j)),
total as (select lang, count(*) n from word group by lang),
f as (select lang, g, count(*) c from ({grams}) group by lang, g having count(*) >= 100),
ext as (select lang, g[:-2] g, c from f where len(g) > 1 union select lang, g[2:] g, c from f where len(g) > 1),
c as (select f.* from f where len(g) > 1 and not exists (select 1 from ext e where e.lang = f.lang and e.g = f.g and e.c >= f.c)),
k as (select c.*, unnest(range(1, len(g))) k from c),
s as (select k.lang, array_to_string(k.g, ' ') phrase, k.c a, k.k, x.c l, y.c r, n, (1000::hugeint * k.c * n) // (x.c::hugeint * y.c) score
      from k join f x on x.lang = k.lang and x.g = k.g[:k.k] join f y on y.lang = k.lang and y.g = k.g[k.k + 1:] join total on total.lang = k.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from b)
select lang, rank, phrase, a, l, r, n::bigint n, score::bigint score from r where rank <= 2000
"""


ORACLE = _sql()
