"""Spelling variants: words that differ by one inserted, deleted or replaced code point, from a dictionary of trie nodes.

The prefixes of all words are the nodes of a trie and get numbers; so do the suffixes, as nodes of the trie of reversed
words. A word with one position skipped is then a pair of integers (node of what stands before, node of what stands
after), and a word with nothing skipped, parted at some place, is such a pair, too. Two words are neighbours just if they
share a pair, at least one of them with a skipped position. A pair names its strings exactly, so nothing has to be verified.

Nodes are numbered in sorted parts of the words, each part by itself: in sorted order, a word shares with the one before
it the nodes of their common prefix and needs new ones past it. A node that goes on into later parts lies on the path of
its part's last word; it is named by that part and its depth, which every part can tell from the list of last words.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import cut, drop

#: One of so many words, by a hash of document and word, has lost a code point.
LOSES_ONE = 199
#: A Python worker hands over its counts when it has counted so many different words.
WORDS_AT_ONCE = 200_000
#: About so many words are numbered together, in at most so many parts: the last word of each is known to all.
WORDS_IN_PART, MOST_PARTS = 8_192, 4_096


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, loses_one: int | None) -> DataFrame:
    """Rows (word, n) that add up to the occurrences of each word of at least this many code points."""
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = find((text.as_py() or "").encode().lower().decode())  # of bytes, lower() changes A to Z alone
                counted.update(words)
                if loses_one:
                    seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for w in words:
                        h = zlib.crc32(w.encode(), seed)
                        if h % loses_one == 0:
                            at = h % len(w)
                            counted[w] -= 1
                            counted[w[:at] + w[at + 1 :]] += 1
                if len(counted) > WORDS_AT_ONCE:
                    yield pa.RecordBatch.from_pydict({"word": list(counted), "n": list(counted.values())})
                    counted.clear()
        if counted:
            yield pa.RecordBatch.from_pydict({"word": list(counted), "n": list(counted.values())})

    return docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")


def numbered(words: DataFrame, name: str, parts: int) -> DataFrame:
    """Of words (name, word) with different words: name, word, id long (in code-point order), nodes array<long>: the
    numbers of its prefixes of 0, 1, ... code points. Equal prefixes have one number, different ones never share it."""
    placed = words.select(name, "word").repartitionByRange(parts, "word").sortWithinPartitions("word")
    placed = cut(placed.withColumn("part", F.spark_partition_id()), "sorted-words")
    ends = placed.groupBy("part").agg(F.max("word").alias("word")).orderBy("part").collect()  # at most MOST_PARTS words
    number, last = [r["part"] for r in ends], [r["word"] for r in ends]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        part, nodes, ids = group.column("part")[0].as_py(), [], []
        own = bisect.bisect_left(number, part)
        count, before, path = len(last[own]), "", [0]
        for k, w in enumerate(group.column("word").to_pylist()):
            common = shared(before, w)
            path = path[: common + 1]
            if len(path) <= len(w):
                # the depths that the last word of an earlier part, or of this one, has in common with w
                for i in range(bisect.bisect_left(last, w[: len(path)], 0, own), own + 1):
                    depth = shared(last[i], w)
                    path += [number[i] << 40 | d for d in range(len(path), depth + 1)]
                    if depth == len(w):
                        break
                fresh = len(w) + 1 - len(path)
                path += range((part << 40) + count + 1, (part << 40) + count + 1 + fresh)
                count += fresh
            nodes.append(path)
            ids.append(part << 32 | k)
            before = w
        found = {"id": pa.array(ids, pa.int64()), "nodes": pa.array(nodes, pa.list_(pa.int64()))}
        return pa.table({name: group.column(name), "word": group.column("word"), **found})

    kind = words.schema[name].dataType.simpleString()
    return placed.groupBy("part").applyInArrow(run, f"{name} {kind}, word string, id long, nodes array<long>")


def shared(a: str, b: str) -> int:
    """How many code points a and b begin with in common."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:  # a[:low] == b[:low], a[:high] != b[:high]
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


#: What a row of pairs says of its word: nothing is skipped; a position is; one is that gives what skipping the one before gave.
WHOLE, SKIPPED, SKIPPED_AGAIN = 0, 1, 2


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, word, nodes, back) to rows (before, after, id, n, kind), two for each code point of a word and one."""
    for b in batches:
        at = np.r_[0, np.cumsum([len(w) + 1 for w in b.column(2).to_pylist()])]
        forward, backward = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        mirror = at[row] + at[row + 1] - 1 - np.arange(at[-1])
        inner = np.ones(len(row), bool)
        inner[at[1:] - 1] = False
        letters = np.frombuffer("".join(b.column(2).to_pylist()).encode("utf-32-le"), np.uint32)
        again = np.r_[False, letters[1:] == letters[:-1]]
        again[at[:-1] - np.arange(len(at) - 1)] = False  # the first of a word
        of = pa.array(np.r_[row, row[inner]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[forward, forward[inner]]),
                pa.array(np.r_[backward[mirror], backward[mirror[inner] - 1]]),
                b.column(0).take(of),
                b.column(1).take(of),
                pa.array(np.r_[np.full(len(row), WHOLE), np.where(again, SKIPPED_AGAIN, SKIPPED)].astype(np.int32)),
            ],
            ["before", "after", "id", "n", "kind"],
        )


def neighbours(pairs: DataFrame) -> DataFrame:
    """Rows (id, n_near, best struct<least, id>) of the words that have neighbours; best: of most occurrences, least = -n.

    A pair is shared by at most one word as a whole and by one word for each letter that can stand at the skipped place:
    no group grows with the table. Each word gets the number of the others and the best of them; no two are put together.
    """
    one = "struct(-n as least, id, kind)"
    groups = pairs.groupBy("before", "after").agg(F.expr(f"sort_array(collect_list({one}))").alias("g")).where("size(g) > 1")
    groups = groups.selectExpr(
        "filter(g, x -> x.kind > 0) skipped", "filter(g, x -> x.kind = 0) whole", "filter(g, x -> x.kind = 1) single"
    )
    bare = "struct({0}.least as least, {0}.id as id)"
    other = "if(x.id = skipped[0].id, get(skipped, 1), skipped[0])"
    rows = groups.selectExpr(
        f"""inline(concat(
            transform(skipped, x -> struct(
                x.id as id,
                size(skipped) - 1 + if(x.kind = 1, size(whole), 0) as near,
                array_min(filter(array({bare.format(other)}, if(x.kind = 1, {bare.format('get(whole, 0)')}, null)), y -> y.id is not null)) as best)),
            transform(whole, x -> struct(x.id as id, size(single) as near, if(size(single) > 0, {bare.format('get(single, 0)')}, null) as best))
        ))"""
    ).where("near > 0")
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, form) to (id, root), the last one reached by following forms. Each round doubles the steps taken; a form has
    several times the occurrences of its word, so that rounds are few."""
    steps = cut(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        past = steps.select(F.col("id").alias("at"), F.col("root").alias("past"))
        longer = steps.join(past, F.col("root") == F.col("at"), "left")
        longer = cut(longer.selectExpr("id", "coalesce(past, root) root", "past is not null moved"), "roots")
        drop(steps)
        steps = longer
        if not steps.where("moved").head(1):
            return steps.select("id", "root")


def variants(
    docs: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, loses_one: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per word: word, form, root (strings), n, n_near, form_n (longs). Words are runs of A-Z, a-z and U+00C0 to U+00FF,
    A to Z in lower case, of at least this many code points and occurrences; form is the neighbour of most occurrences
    (ties: the first in code-point order) if these are ratio times the word's; root is where forms lead.

    With loses_one, one of so many words loses a code point, chosen by crc32 of "<id>:<word>"; a null id counts as "".
    Null and empty texts hold no words; rows that repeat count each; other columns, null or of any name, change nothing.
    An empty table, or one without words that often, gives no rows. Texts and words of any length are taken whole: a word
    makes two rows for each of its code points and one more.
    """
    counted = occurrences(docs, id_col, text_col, least_chars, loses_one).groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted.where((F.col("n") >= least_n) & (F.length("word") >= least_chars)), "words")
    parts = max(1, min(MOST_PARTS, -(-counted.count() // WORDS_IN_PART)))
    words = cut(numbered(counted, "n", parts), "forward")
    back = numbered(words.select(F.col("id").alias("of"), F.reverse("word").alias("word")), "of", parts)
    both = words.join(back.select("of", F.col("nodes").alias("back")), F.col("id") == F.col("of"))
    every = both.select("id", "n", "word", "nodes", "back").mapInArrow(pairs, "before long, after long, id long, n long, kind int")
    near = cut(neighbours(every), "near")
    drop(counted)
    words = words.select("id", "word", "n")
    forms = words.join(near, "id").where(F.expr(f"-best.least >= {ratio} * n"))
    forms = cut(forms.selectExpr("id", "best.id form", "-best.least form_n"), "forms")
    name = words.select(F.col("id").alias("at"), F.col("word").alias("name"))
    led = forms.join(roots(forms), "id")
    led = led.join(name.withColumnsRenamed({"at": "form", "name": "form_word"}), "form")
    led = led.join(name.withColumnsRenamed({"at": "root", "name": "root_word"}), "root")
    out = words.join(near.select("id", "n_near"), "id", "left").join(led, "id", "left")
    return out.selectExpr(
        "word", "form_word form", "coalesce(root_word, word) root", "n", "coalesce(n_near, 0) n_near", "form_n"
    )
