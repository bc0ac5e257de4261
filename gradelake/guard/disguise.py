"""Text that reads like prose only after decoding: rotated by 13 letters, reversed, or with digits for letters.

No dictionary is needed: prose of any kind has common words (articles, prepositions, pronouns). A disguised sentence has
none of them as it stands and gains several once decoded. Each word is looked up once in a table that says as what it
would be a common word, so no text is ever rewritten to be judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words that make up much of any prose in the languages that are accepted.
COMMON = (
    "the of and to in is that for it with as on are this be by from or an have which you not at was but they his her she "
    "there one all will when who what if can do has would their we our your should then than into only how its were been "
    "el la de que y en los se del las por un para con no una su al lo como más pero sus le ya este cuando muy sin sobre "
    "ser tiene también hasta hay donde quien desde todo nos son está esta eso ese entre porque "
    "o a e do da em um não uma os na mais dos ao ele das seu sua ou quando muito nos já eu também só pelo pela até isso "
    "são foi está seus mesmo sem nas"
).split()
#: Which of these are common in which language.
BY_LANGUAGE = tuple(
    frozenset(words.split()) for words in (
        "the of and to in is that for it with as on are this be by from or an a have which you not at was but they his her she "
        "there one all will when who what if can do has would their we our your should then than into only how its were been no",
        "el la de que y e en a o los se del las por un para con no una su al lo como más pero sus le ya este cuando muy sin sobre "
        "ser tiene también hasta hay donde quien desde todo nos son está esta eso ese entre porque os",
        "o a e do da de em que se no na um uma não os mais dos ao ele das seu sua ou quando muito nos já eu também só pelo pela até "
        "isso são foi está seus mesmo sem nas para por como este esta ser sobre entre lo la las desde todo porque",
    )
)
PLAIN, ROTATED, REVERSED = 1, 2, 4
_ROTATE = str.maketrans("abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")
#: Letters that digits and signs stand for; 1 is an i in one reading and an l in the other.
_LEET = {one: str.maketrans("03457@$891", "oeastasbg" + one) for one in "il"}
#: Parts of a segment between which no sentence runs on, and how many words are judged together.
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
MOST_WORDS, LEAST_WORDS = 20, 5
_TOKEN = re.compile(r"[\w@$]+")
_WORD = re.compile(r"[^\w]*[^\W\d_]+(?:['’-][^\W\d_]+)*[^\w]*")
_LEET_WORD = re.compile(r"[^\w@$]*[\w@$]+(?:['’-][\w@$]+)*[^\w@$]*")
_MIXED = re.compile(r"(?=[\w@$]*[^\W\d_])(?=[\w@$]*[013457@$])[\w@$]{3,}")
_LINKS = re.compile(r"https?://\S+|<[^<>]*>|[\[\]()]")


@cache
def table(common: tuple[str, ...] = tuple(COMMON)) -> dict[str, int]:
    """Words and as what they are common: as they stand, rotated, reversed."""
    out: dict[str, int] = {}
    for w in common:
        for bit, form in ((PLAIN, w), (ROTATED, w.translate(_ROTATE)), (REVERSED, w[::-1])):
            out[form] = out.get(form, 0) | bit
    return out


def segments(text: str) -> Iterator[list[str]]:
    """Words of the sentences and lines of a text, at most MOST_WORDS and at least LEAST_WORDS together."""
    for sentence in _SENTENCE.split(_LINKS.sub(" ", text)):
        words = sentence.split()
        for i in range(0, len(words) - LEAST_WORDS + 1, MOST_WORDS):
            if len(words) - i >= LEAST_WORDS:
                yield words[i : i + MOST_WORDS]


def _gains(before: list[str], after: list[str], n_words: int) -> bool:
    """At least three more different common words, twice as many of them, and a fifth of all words."""
    return len(set(after)) - len(set(before)) >= 3 and len(after) >= max(2 * len(before), 0.2 * n_words)


def reading(words: list[str]) -> str | None:
    """As what these words (in lower case) read like prose, if they do not as they stand: rot13, reversed, leet; or None."""
    known = table()
    n, segment = len(words), " ".join(words)
    tokens = _TOKEN.findall(segment)
    hits = [(t, known[t]) for t in tokens if t in known]
    plain = [t for t, bits in hits if bits & PLAIN]
    if 5 * len(plain) > 2 * n:  # prose: twice as many common words would be four fifths of all
        return None
    rotated = [t for t, bits in hits if bits & ROTATED]
    turned = [t for t, bits in hits if bits & REVERSED]
    gain = "rot13" if _gains(plain, rotated, n) else "reversed" if _gains(plain, turned, n) else None
    if gain:
        spoken = [w for w in words if any(map(str.isalnum, w))]
        if 5 * sum(bool(_WORD.fullmatch(w)) for w in spoken) >= 4 * len(spoken):
            return gain
    mixed = _MIXED.findall(segment)
    if len(mixed) >= 3:
        read = [[t.translate(m) for m in _LEET.values()] for t in tokens if t in mixed or not t.isalpha()]
        leet = [next((r for r in rs if known.get(r, 0) & PLAIN), "") for rs in read]
        spoken = [w for w in words if any(map(str.isalnum, w))]
        if _gains(plain, plain + [w for w in leet if w], n) and 5 * sum(
            bool(_LEET_WORD.fullmatch(w)) for w in spoken
        ) >= 4 * len(spoken):
            return "leet"
    return None


def disguised(text: str) -> Iterator[tuple[str, str]]:
    """(reading, segment) of the segments of a text, in lower case, that are readable only once decoded."""
    for words in segments(text):
        if kind := reading(words):
            yield kind, " ".join(words)


def in_one_language(kind: str, segment: str) -> bool:
    """Whether a segment that reads so (see reading()) gains three different common words of one and the same language.

    Short words turned round are now and then a word of some language, each of another one; a sentence has those of its own.
    """
    tokens = _TOKEN.findall(segment)
    before = {t for t in tokens if table().get(t, 0) & PLAIN}
    if kind == "leet":
        forms = {t.translate(m) for t in tokens if not t.isalpha() for m in _LEET.values()}
    else:
        forms = {t.translate(_ROTATE) if kind == "rot13" else t[::-1] for t in tokens}
    gained = 3 if kind == "leet" else 3 + len(before)
    return any(len(forms & common) >= gained for common in BY_LANGUAGE)


def obfuscated_segments(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, encoding, segment): each sentence, or run of twenty words of one, that reads like prose only once decoded.

    A null text has none. Each text is judged on its own in one map; nothing is shuffled.
    """
    from gradelake.guard.inspect import normalise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (k, kind, segment)
                for k, t in enumerate(b.column(1).to_pylist()) if t for kind, segment in disguised(normalise(t))
            ]
            where, kinds, found = zip(*rows) if rows else ((), (), ())
            own = pc.take(b.column(0), pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(kinds, pa.string()), pa.array(found, pa.string())], [key, "encoding", "segment"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, encoding string, segment string")


def _sql() -> str:
    """What SQL needs to judge segments: with seg(doc_id, segment) defined, rows (doc_id, encoding, segment)."""
    listed = lambda ws: "[" + ", ".join("'" + w + "'" for w in dict.fromkeys(ws)) + "]"
    rotated, turned = listed(w.translate(_ROTATE) for w in COMMON), listed(w[::-1] for w in COMMON)
    leet = lambda t, one: f"translate({t}, '03457@$891', 'oeastasbg{one}')"
    gain = "len(list_distinct({0})) - len(list_distinct(plain)) >= 3 and len({0}) >= 2 * len(plain) and 5 * len({0}) >= n"
    share = lambda p: rf"5 * len(list_filter(spoken, lambda w: regexp_full_match(w, '{p}'))) >= 4 * len(spoken)"
    word, leet_word = r"[^\pL\pN_]*\pL+([''’-]\pL+)*[^\pL\pN_]*", r"[^\pL\pN_@$]*[\pL\pN_@$]+([''’-][\pL\pN_@$]+)*[^\pL\pN_@$]*"
    return rf"""
tok as (select doc_id, segment, string_split(segment, ' ') w, regexp_extract_all(segment, '[\pL\pN_@$]+') t from seg),
hit as (select *, len(w) n, list_filter(w, lambda x: regexp_matches(x, '[\pL\pN]')) spoken, list_filter(t, lambda x: list_contains({listed(COMMON)}, x)) plain,
    list_filter(t, lambda x: list_contains({rotated}, x)) rot, list_filter(t, lambda x: list_contains({turned}, x)) rev,
    list_filter(t, lambda x: length(x) >= 3 and regexp_matches(x, '\pL') and regexp_matches(x, '[013457@$]')) mixed from tok),
let as (select *, plain || list_filter(list_transform(list_filter(t, lambda x: list_contains(mixed, x) or not regexp_full_match(x, '\pL+')), lambda x:
    case when list_contains({listed(COMMON)}, {leet('x', 'i')}) then {leet('x', 'i')} when list_contains({listed(COMMON)}, {leet('x', 'l')}) then {leet('x', 'l')} else '' end), lambda x: x <> '') leet from hit),
kind as (select doc_id, segment, case when 5 * len(plain) > 2 * n then null
    when ({gain.format('rot')}) and {share(word)} then 'rot13' when not ({gain.format('rot')}) and ({gain.format('rev')}) and {share(word)} then 'reversed'
    when len(mixed) >= 3 and ({gain.format('leet')}) and {share(leet_word)} then 'leet' end as encoding from let)
select doc_id, encoding, segment from kind where encoding is not null"""


JUDGED = _sql()
