"""Whether quotes stand in their documents, words passed over that a reader may pass over."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions.reader import NUMERAL, marked_words, visible, visible_text

#: A quote has so many words at least; one cut short by an ellipsis needs a longer beginning, and lacks few words.
LEAST_WORDS, LEAST_BEGINNING, MOST_MISSING = 3, 6, 4
ELLIPSES = ("...", "…")
MARKS = (1, 2, 4, 8)


class Passage:
    """Words of a document with their marks, ready to be searched."""

    def __init__(self, words: Sequence[tuple[str, int]]) -> None:
        self.words, self.places = words, defaultdict(list)
        for i, (w, _) in enumerate(words):
            self.places[w].append(i)
        self.next = [0] * len(words)  # where the words of equal marks end
        for i in range(len(words) - 1, -1, -1):
            same = i + 1 < len(words) and words[i + 1][1] == words[i][1]
            self.next[i] = self.next[i + 1] if same else i + 1

    def longest(self, quote: Sequence[str], passed: int = 0, kept: int = 0) -> int:
        """How many words of the quote's beginning stand together somewhere, if all words of some kinds are passed over.

        The kinds are chosen for the whole document: words of a kind are either all read or all passed over. passed and
        kept fix that for some kinds (as marks) beforehand; for others it is settled when such a word is first met.
        """
        best = 0
        for start in self.places.get(quote[0], ()) if quote else ():
            todo = [(start, 0, passed, kept)]
            while todo:
                at, n, on, off = todo.pop()
                while n < len(quote) and at < len(self.words):
                    word, marks = self.words[at]
                    if n and marks & ~off:  # passing over it is another way to go on (a match begins with a word read)
                        todo += [(self.next[at], n, on | m, off) for m in MARKS if marks & ~off & m and not marks & on]
                    if marks & on:
                        at = self.next[at]
                        continue
                    if word != quote[n]:
                        break
                    at, n, off = at + 1, n + 1, off | marks
                if n > best:
                    best = n
                if best == len(quote):
                    return best
        return best


def without_numerals(quote: str) -> list[str]:
    return [w for w, marks in marked_words(quote) if not marks & NUMERAL]


def is_grounded(quote: str, passage: Passage) -> bool:
    """The quote is a run of words of the passage in one of its readings; or, if it ends in an ellipsis, its beginning is."""
    cut = quote.rstrip().endswith(ELLIPSES)
    for words, passed, kept in ((visible(quote).split(), 0, NUMERAL), (without_numerals(quote), NUMERAL, 0)):
        got = passage.longest(words, passed, kept)
        if LEAST_WORDS <= got == len(words):
            return True
        # the last word may be half a word, so a beginning is always shorter than the quote
        if cut and min(got, len(words) - 1) >= max(LEAST_BEGINNING, len(words) - MOST_MISSING):
            return True
    return False


def grounded(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, doc_id, grounded): whether each quote is a run of at least three visible words of its document. Images,
    link labels, code and list numerals may be passed over, each kind as a whole; a quote cut short (an ellipsis) needs six
    leading words and may lack four. A null quote or document is grounded in nothing; a document that is not there gives
    no row. quotes: (quote_id, doc_id, quote).

    The plain reading settles most quotes in the JVM; only those still open meet the document's marked words.
    """
    d = docs.select(F.col("doc_id").alias("k"), "text", F.concat(F.lit(" "), visible_text(F.col("text")), F.lit(" ")).alias("hay"))
    q = quotes.select("quote_id", "doc_id", "quote", visible_text(F.col("quote")).alias("w"))
    plain = (F.size(F.split("w", " ")) >= LEAST_WORDS) & F.contains("hay", F.concat(F.lit(" "), F.col("w"), F.lit(" ")))
    rows = q.join(d, F.col("doc_id") == F.col("k")).withColumn("plain", F.coalesce(plain, F.lit(False)))
    may_differ = F.col("text").rlike(r"[\[`]|(?m)^[ \t]*[0-9]{1,3}[.)][ \t]") | F.col("quote").rlike(r"(\.\.\.|…)\s*$|(?m)^[ \t]*[0-9]{1,3}[.)][ \t]")
    rows = rows.withColumn("open", ~F.col("plain") & F.coalesce(may_differ, F.lit(False)))
    rows = rows.select("quote_id", "doc_id", "plain", F.when(F.col("open"), F.col("quote")).alias("q"), F.when(F.col("open"), F.col("text")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, passage, out = None, None, []
            for plain, quote, text in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if quote is not None and text is not None:
                    if text != last:
                        last, passage = text, Passage(marked_words(text))
                    plain = is_grounded(quote, passage)
                out.append(plain)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["quote_id", "doc_id", "grounded"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"quote_id {kinds['quote_id']}, doc_id {kinds['doc_id']}, grounded boolean")
