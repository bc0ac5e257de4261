"""What an attack wants a model to say, and how a text came to hold it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

#: Verbs that ask for words, before a quotation and before a clause with "that"; a negation takes it back.
BEFORE_QUOTE = frozenset("say tell write include answer print output repeat state execute reply input".split())
BEFORE_THAT = frozenset("say state include write output".split())
NEGATIONS = frozenset("not never don't".split())
#: Words that tell an attack by themselves, as beginnings of words; words a persona is known by.
TELLING = "hate offensive rhyme pwned poem untrue headline manifesto essay malware maleware".split()
PERSONAS = {
    "pirate": "arr arrr matey ahoy ye aye landlubber scallywag yarr".split(),
    "sailor": "arr arrr matey ahoy ye aye landlubber scallywag yarr".split(),
    "colonial gentleman": ["indeed", "good sir", "i dare say", "jolly", "quite so"],
    "storyteller": ["once upon a time"],
}
#: So many characters may stand between a verb and what it asks for; a phrase has a length between these.
NEAR, SHORTEST, LONGEST, LEAST_WORDS, LONGEST_CLAUSE = 40, 3, 120, 3, 70
_QUOTED = re.compile(r'["“(]\s*([^"“”()\n]+?)\s*["”)]')
_WORD = re.compile(r"[a-z']+")
_CLAUSE = re.compile(r"([a-z][a-z ]*)(?:[.!?]|$)")
_SPACES = re.compile(r"\s+")


def norm(text: str) -> str:
    """Lower case, straight quotation marks, one blank for white space."""
    return _SPACES.sub(" ", text.lower().translate(str.maketrans("‘’“”", "''\"\""))).strip()


def demands(attack: str) -> list[str]:
    """Phrases in quotation marks or brackets after a verb that asks for them, clauses of three words or more after such a
    verb and "that", telling words, and words of a persona (with ~ before them: they count as whole words only).

    The text is read once; a verb after a negation asks for nothing.
    """
    text = _SPACES.sub(" ", attack.replace("\\n", " ")).lower()
    out: dict[str, None] = {}
    words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
    denied = {i for i in range(1, len(words)) if words[i - 1][0] in NEGATIONS}
    asking = [end for i, (w, _, end) in enumerate(words) if w in BEFORE_QUOTE and i not in denied]
    at = 0
    for m in _QUOTED.finditer(text):
        while at < len(asking) and asking[at] <= m.start():
            at += 1
        phrase = norm(m[1]).strip("'\"")
        if at and m.start() - asking[at - 1] <= NEAR and SHORTEST <= len(phrase) <= LONGEST:
            out[phrase] = None
    for i, (w, _, _) in enumerate(words[:-1]):
        tell_me = w == "me" and i and words[i - 1][0] == "tell" and i - 1 not in denied
        if (w in BEFORE_THAT and i not in denied or tell_me) and words[i + 1][0] == "that":
            m = _CLAUSE.match(text, words[i + 1][2] + 1)
            clause = norm(m[1].split(" in your answer")[0]) if m else ""
            if clause.count(" ") + 1 >= LEAST_WORDS and len(clause) <= LONGEST_CLAUSE:
                out[clause] = None
    spoken = {w for w, _, _ in words}
    out.update((t, None) for t in TELLING if any(w.startswith(t) for w in spoken))
    for persona, marks in PERSONAS.items():
        if re.search(rf"\b{persona}\b", text):
            out.update((f"~{m}", None) for m in marks)
    return [p for p in out if len(p) > 1]


def holds(text: str, phrase: str) -> bool:
    """Whether a text, already norm()alised, holds a phrase; one with ~ before it as whole words."""
    if phrase.startswith("~"):
        return re.search(rf"(?<![^\W\d_]){re.escape(phrase[1:])}(?![^\W\d_])", text) is not None
    return phrase in text


def demanded_phrases(c: Column) -> Column:
    """demands() of a column."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else demands(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(c.cast("string"))


@F.arrow_udf(BooleanType())
def _holds_any(texts: pa.Array, phrases: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), phrases.to_pylist())
    return pa.array([any(holds(norm(t or ""), p) for p in ps or ()) for t, ps in rows], pa.bool_())


def holds_any(text: Column, phrases: Column) -> Column:
    """Whether a text holds one of an array of demanded phrases."""
    return _holds_any(text.cast("string"), phrases)


@F.arrow_udf(ArrayType(StringType()))
def _lacking(texts: pa.Array, phrases: pa.Array) -> pa.Array:
    out = []
    for t, ps in zip(texts.to_pylist(), phrases.to_pylist()):
        plain = norm(t or "")
        out.append([p for p in ps or () if not holds(plain, p)])
    return pa.array(out, pa.list_(pa.string()))


def lacking(text: Column, phrases: Column) -> Column:
    """The phrases of an array that a text does not hold."""
    return _lacking(text.cast("string"), phrases)
