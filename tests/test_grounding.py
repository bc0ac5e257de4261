import itertools
import random
import re

from gradelake.functions.reader import marked_words
from gradelake.operators import grounding as R


def readings(words, quote):
    """The longest beginning of a quote in any of the 16 readings, one after the other."""
    best = {}
    for mask in range(16):
        kept = [w for w, marks in words if not marks & mask]
        best[mask] = max((next((k for k in range(len(quote) + 1) if k == len(quote) or i + k >= len(kept) or kept[i + k] != quote[k]), 0) for i in range(len(kept))), default=0)
    return best


def test_one_matcher_is_sixteen_readings():
    rng = random.Random(5)
    for _ in range(1500):
        words = []
        while len(words) < 14:
            marks = rng.choice((0, 0, 1, 2, 4, 8, 3))
            words += [(rng.choice("abc"), marks) for _ in range(rng.randrange(1, 4))]
        quote = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        want, passage = readings(words, quote), R.Passage(words)
        assert passage.longest(quote) == max(want.values()), (words, quote)
        assert passage.longest(quote, passed=8) == max(v for m, v in want.items() if m & 8)
        assert passage.longest(quote, kept=8) == max(v for m, v in want.items() if not m & 8)


def test_marks_of_words():
    md = "1. See [the `docs` here](u) and ![a cat](i) or `x = 1`.\n2) next [![in](b) out](c) end [ref][r] 3. no"
    got = dict(marked_words(md))
    assert got == {"1": 4, "see": 0, "the": 2, "docs": 6, "here": 2, "and": 0, "a": 1, "cat": 1, "or": 0, "x": 4, "2": 8, "next": 0, "in": 3, "out": 2, "end": 0, "ref": 0, "3": 0, "no": 0} | {"1": got["1"]}
    assert [m for w, m in marked_words(md) if w == "1"] == [8, 4]


def quoted(text, *quotes):
    passage = R.Passage(marked_words(text))
    return [R.is_grounded(q, passage) for q in quotes]


def test_quotes():
    doc = "# Tool\n\nRun ![badge](https://x) the `tool -x` command, then read [the guide](https://y) twice.\n\n1. First step\n2. Second step is longer than the first step by far"
    assert quoted(doc, "Run the command, then read twice.", "run badge the tool x command", "Run the tool -x command", "read the guide twice", "then read twice") == [True] * 5
    assert quoted(doc, "First step Second step is longer", "1. First step 2. Second step", "2. Second step is longer") == [True, True, True]
    assert quoted(doc, "Second step is longer than the first thing...", "Second step is longer than nothing at all...", "step is longer…", "Second step is longer than the fir...") == [True, False, True, True]
    assert quoted(doc, "read twice the guide", "Run command", "", "the badge tool", "First Second step is longer") == [False] * 5
    assert quoted("", "a b c") == [False]


def test_grounded_rows(spark):
    docs = spark.createDataFrame([(1, "one two ![x](y) three four five"), (2, None), (3, "a b c d")], "doc_id long, text string")
    quotes = [(1, 1, "one two three"), (2, 1, "One, two. x"), (3, 1, "two five"), (4, 1, None), (5, 2, "a b c"), (6, 3, "b c d"), (7, 9, "a b c"), (8, 1, "three four five")]
    got = R.grounded(spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string"), docs).collect()
    assert {r["quote_id"]: r["grounded"] for r in got} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 8: True}
