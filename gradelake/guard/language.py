"""Language of a text by profiles of letter trigrams: ranks of the commonest ones, learned from labelled documents.

Spark counts the trigrams of each language; a profile keeps the first RANKS of them. A text's trigrams are ranked the same
way, and the language is the one whose ranks are out of place the least. Profiles are a few hundred numbers a language.

A passage of another language in the midst of a line, however long, is not the text's own: it is left out before.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import text as X
from gradelake.functions.reader import sliced

#: How many trigrams a profile has, and how many languages at most.
RANKS, MOST_LANGUAGES = 400, 200
#: Texts with fewer letters are not judged.
MIN_LETTERS = 40
#: Languages that documents may be in.
SUPPORTED = ("en", "pt", "es")
#: A supported language so much further than the nearest one, as a share of the distance, is taken instead of it.
NEAR_TIE = 0.01
#: Lines are looked at for passages of another language in runs of so many words, and among so many languages.
RUN, AMONG = 4, 4
#: How much likelier (natural logarithm) a line must be with its language around the passage than with another one there,
#: and with the passage in another language than all in its own.
AROUND, PASSAGE = 5.0, 20.0


def prose(text: Column) -> Column:
    """Lower-case text without code, tags, link targets and URLs. Other signs, digits and blanks stay: they are no letters. A
    text in which none of these begins is left alone."""
    c = F.coalesce(text, F.lit(""))
    some = [F.contains(c, F.lit(sign)) for sign in ("`", "~~~", "<", "[", "http")]
    return F.lower(F.when(reduce(Column.__or__, some), X.without_markup(c)).otherwise(c))


@cache
def letters() -> np.ndarray:
    """Of each code point itself, if it is a letter, else a blank."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(sys.maxunicode + 1)), np.int64, sys.maxunicode + 1)


def placed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of the letters of a text in lower case, words apart by one blank, as numbers; of each its word's number, and
    its line's."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c, line = np.r_[32, letters()[raw], 32], np.r_[0, np.cumsum(raw == 10), 0]
    keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]
    c, line = c[keep], line[keep]
    if len(c) < 3:
        return (np.zeros(0, np.int64),) * 3
    grams, own = c[:-2] << 42 | c[1:-1] << 21 | c[2:], c[1:-1] != 32
    return grams[own], np.cumsum(~own)[own], line[1:-1][own]


def codes(text: str) -> np.ndarray:
    """The trigrams of placed()."""
    return placed(text)[0]


def begins(numbers: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.r_[0, np.flatnonzero(np.diff(numbers)) + 1]


def ranked(grams: np.ndarray) -> np.ndarray:
    """The commonest trigrams, most often first, of equal ones the smaller number."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.lexsort((values, -counts))][:RANKS]


@dataclass(frozen=True)
class Profiles:
    """Languages and, for each known trigram (sorted), its rank in each, RANKS where it has none, and the logarithm of its share."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    weights: np.ndarray

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known trigrams are, and which of these are known."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return at, self.grams[at] == grams

    def own(self, text: str) -> np.ndarray:
        """The trigrams of a text but for those of passages: of each line the words in its midst that are likelier in another
        language, if what is around them is of one language, told from all others that may be around some other part of it."""
        grams, word, line = placed(text)
        if not len(grams) or len(self.languages) < 2:
            return grams
        at, known = self.places(grams)
        first = begins(word)
        said = np.add.reduceat(np.where(known[:, None], self.weights[at], 0.0), first, axis=0)  # a row for each word
        best = np.add.reduceat(said, np.arange(0, len(said), RUN), axis=0).argmax(axis=1)
        if (best == best[0]).all():
            return grams
        some = np.argsort(-np.bincount(best, minlength=said.shape[1]), kind="stable")[:AMONG]
        said, line = said[:, some], line[first]
        start = begins(line)
        end = np.r_[start[1:], len(said)]
        apart = np.repeat(np.arange(len(start)), end - start) * 1e9  # lines so far apart that no sum passes from one to the next
        total, after = np.add.reduceat(said, start, axis=0), np.cumsum(said, axis=0)
        before = after - said
        shape = (len(start), len(some))
        likely, gain, other = np.full(shape, -np.inf), np.zeros(shape), np.zeros(shape, np.int64)
        for a in range(len(some)):
            for b in range(len(some)):
                if a != b:
                    low = np.minimum.accumulate(before[:, b] - before[:, a] - apart)
                    most = np.maximum.reduceat(after[:, b] - after[:, a] - apart - low, start)
                    up = total[:, a] + most > likely[:, a]
                    likely[up, a], gain[up, a], other[up, a] = (total[:, a] + most)[up], most[up], b
        ordered, around = np.sort(likely, axis=1), likely.argmax(axis=1)
        found = (ordered[:, -1] - ordered[:, -2] >= AROUND) & (gain[np.arange(len(start)), around] >= PASSAGE)
        keep = np.ones(len(said), bool)
        for k in np.flatnonzero(found):
            i, a, b = slice(start[k], end[k]), around[k], other[k, around[k]]
            low, up = before[i, b] - before[i, a], after[i, b] - after[i, a]
            last = int((up - np.minimum.accumulate(low)).argmax())
            keep[start[k] + int(low[: last + 1].argmin()) : start[k] + last + 1] = False
        return grams[np.repeat(keep, np.diff(np.r_[first, len(grams)]))]

    def distances(self, text: str) -> np.ndarray:
        """How far the ranks of the text's own trigrams are from each language's, 0 to 1."""
        own = ranked(self.own(text))
        at, known = self.places(own)
        theirs = np.where(known[:, None], self.ranks[at], RANKS)
        apart = np.where(theirs == RANKS, RANKS, np.abs(theirs - np.arange(len(own))[:, None]))
        return apart.sum(axis=0) / (RANKS * max(1, len(own)))

    def detect(self, text: str, supported: tuple[str, ...] = SUPPORTED) -> tuple[str, str]:
        """(language, answer) of prose: the nearest language, and what the policy asks for: a supported language, other
        or unknown (under MIN_LETTERS letters)."""
        if sum(map(str.isalpha, text)) < MIN_LETTERS or not self.languages:
            return "unknown", "unknown"
        far = self.distances(text)
        best = self.languages[int(far.argmin())]
        if best in supported:
            return best, best
        near = [(d, name) for d, name in zip(far, self.languages) if name in supported]
        if near and min(near)[0] <= far.min() * (1 + NEAR_TIE):
            return best, min(near)[1]
        return best, "other"


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text") -> Profiles:
    """Profiles from documents with a language; rows without one, or without text, teach nothing.

    Counts cover all rows. At most MOST_LANGUAGES languages (those of most trigrams) times RANKS rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_lang: dict[str, Counter[int]] = defaultdict(Counter)
            for part in sliced(b):
                texts: dict[str, list[str]] = defaultdict(list)
                for name, t in zip(*(c.to_pylist() for c in part.columns)):
                    texts[name].append(t)
                for name, said in texts.items():  # a trigram has a letter in the middle: a blank between texts adds none
                    found = pa.array(codes(" ".join(said))).value_counts()
                    by_lang[name].update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
            for name, n in by_lang.items():
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(n), "gram": list(n), "n": list(n.values())})

    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang), prose(F.col(text)).alias("__prose"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counts = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < RANKS)  # a group limit
    first = F.collect_list(F.struct("gram", "rank", "n")).alias("ranked")  # RANKS rows at most
    most = counts.groupBy("lang").agg(F.sum("n").alias("size"), first).orderBy(F.desc("size"), "lang").limit(MOST_LANGUAGES)
    got = most.select("lang", F.inline("ranked")).collect()
    languages = tuple(sorted({r["lang"] for r in got}))
    grams = np.unique(np.array([r["gram"] for r in got], np.int64))
    ranks = np.full((len(grams), len(languages)), RANKS)
    counts = np.zeros(ranks.shape)
    for r in got:
        at = np.searchsorted(grams, r["gram"]), languages.index(r["lang"])
        ranks[at], counts[at] = r["rank"], r["n"]
    least = np.where(counts > 0, counts, np.inf).min(axis=0, initial=np.inf) / 2  # for what is rarer than the rarest
    return Profiles(languages, grams, ranks, np.log(np.maximum(counts, least) / np.maximum(1, counts.sum(axis=0))))


def detect(
    docs: DataFrame, profiles: Profiles, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (),
    supported: tuple[str, ...] = SUPPORTED,
) -> DataFrame:
    """(key, keep..., nearest, detected) per row: the nearest language, and a supported one, other or unknown. A null text
    is unknown. One map; the profiles go with it."""
    names = [key, *keep]
    rows = docs.select(*names, prose(F.col(text)).alias("__prose"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.detect(t, supported) for part in sliced(b) for t in part.column(len(names)).to_pylist()]
            nearest, answers = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(nearest, pa.string()), pa.array(answers, pa.string())],
                [*names, "nearest", "detected"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, nearest string, detected string")


def allowed(detected: Column, languages: tuple[str, ...] = SUPPORTED) -> Column:
    """Whether a document may be taken: unknown languages may, others and known ones not among these may not."""
    return (detected == "unknown") | detected.isin(*languages)


def row_language(docs: DataFrame, profiles: Profiles, declared: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, language): the declared language's first part (pt-BR: pt), else the nearest of the text, else null."""
    first = F.get(F.split(F.lower(declared), "[-_]"), F.lit(0))
    both = docs.withColumn("__first", F.when(first != "", first))
    found = detect(both, profiles, text, key, ("__first",))
    nearest = F.when(F.col("nearest") != "unknown", F.col("nearest"))
    return found.select(key, F.coalesce("__first", nearest).alias("language"))
