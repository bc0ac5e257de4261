"""One pass over Markdown and HTML: what a reader sees of it, and what is left of it without links."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that stand inside a word or sentence, and tags whose content is not shown.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
UNSEEN = frozenset("script style".split())
#: Where something other than plain text may begin.
_MARK = re.compile(
    r"""(?P<comment><!--)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9-]*)(?:[\s/][^<>]*)?>"""
    r"""|(?P<line>^[ \t]*(?:`{3,}|~{3,})[^\n]*$|^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S[^\n]*$)"""
    r"""|(?P<open>!?\[)|(?P<target>\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\]\[[^\[\]\n]*\])|(?P<url>https?://[^\s<>]+)""",
    re.M,
)
_WORD = re.compile(r"[^\W_]+")
#: ASCII but letters and digits, as blanks.
_NO_LETTERS = {c: " " for c in range(128) if not chr(c).isalnum()}
_BOX = re.compile(r"\[[ xX]\](?=\s)")
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in UNSEEN}


#: The same, and what a quote may pass over: code between backticks, numerals of a list.
_SKIPPABLE = re.compile(_MARK.pattern + r"|(?P<code>`[^`\n]*`)|(?P<numeral>^[ \t]*\d{1,3}[.)](?=[ \t]))", re.M)
#: How all of these but whole lines and numerals begin: told by one character, so that prose is passed over quickly.
_BEGINS, _SKIPPABLE_BEGINS = re.compile(r"<|\[|\]|https?://"), re.compile(r"<|\[|\]|`|https?://")
_NUMERAL = re.compile(r"^[ \t]*\d{1,3}[.)](?=[ \t])", re.M)
#: Marks of words: alternative text of an image, label of a link, code, numeral of a list.
IMAGE, LABEL, CODE, NUMERAL = 1, 2, 4, 8


def _finder(text: str, marked: bool) -> Callable[[str, int], re.Match[str] | None]:
    """What finds the next mark of a text from a place on. Lines that are marks as a whole need a look at every place."""
    if "```" in text or "~~~" in text or "]:" in text or (marked and _NUMERAL.search(text)):
        return (_SKIPPABLE if marked else _MARK).search
    begins, mark = (_SKIPPABLE_BEGINS if marked else _BEGINS).search, (_SKIPPABLE if marked else _MARK).match

    def find(text: str, at: int) -> re.Match[str] | None:
        place = at
        while b := begins(text, place):
            start = b.start()
            if start > at and text[start] == "[" and text[start - 1] == "!":
                m = mark(text, start - 1)
            else:
                m = mark(text, start)
            if m:
                return m
            place = start + 1
        return None

    return find


def _pieces(text: str, marked: bool) -> list[list]:
    """[string, marks] of what is seen of a text, in order; markup leaves blanks, tags inside a sentence nothing."""
    out: list[list] = []
    opened: list[tuple[int, int]] = []
    gone: set[str] = set()
    if "[" in text:
        text = _BOX.sub(" ", text)
    at, find = 0, _finder(text, marked)
    while m := find(text, at):
        if m.start() > at:
            out.append([text[at : m.start()], 0])
        at, kind = m.end(), m.lastgroup
        if m["tag"]:
            name = m["tag"].lower()
            if name in UNSEEN and not m["close"] and name not in gone:
                end = _CLOSING[name].search(text, at)
                if end:
                    at = end.end()
                else:
                    gone.add(name)  # none will close: not looked for again
            if name not in INLINE:
                out.append([" ", 0])
        elif kind == "comment":
            end = -1 if "comment" in gone else text.find("-->", at)
            if end < 0:
                gone.add("comment")
            else:
                at = end + 3
            out.append([" ", 0])
        elif kind == "open":
            out.append([" ", 0])
            opened.append((len(out), IMAGE if m["open"][0] == "!" else LABEL))
        elif kind == "target":
            if opened:  # the target of a link; what stands since the bracket is its label
                start, mark = opened.pop()
                if mark == IMAGE or m["target"][1] == "(":
                    for piece in out[start:] if marked else ():
                        piece[1] |= mark
                out.append([" ", 0])
            else:  # brackets in a text
                out.append([f" {m['target'][1:]} ", 0])
        elif kind in ("code", "numeral"):
            out += [[" ", 0], [m[0], CODE if kind == "code" else NUMERAL], [" ", 0]]
        else:
            out.append([" ", 0])
    out.append([text[at:], 0])
    return out


def _plain(text: str) -> str:
    text = html.unescape(text) if "&" in text else text
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _words(text: str) -> list[str]:
    """Runs of letters and digits."""
    if text.isascii():
        return text.translate(_NO_LETTERS).split()
    words: list[str] = []
    for w in text.split():
        if w.isalnum():
            words.append(w)
        else:
            words += _WORD.findall(w)
    return words


def visible(text: str) -> str:
    """The words a reader sees, in lower case, with one blank between them: letters and digits alone.

    Comments, scripts, styles, lines that open or close a fence, link definitions, link targets, check boxes and URLs are
    not seen; tags inside a sentence leave nothing, others a gap; entities of all kinds are decoded once, and compatibility
    forms (NFKC) are what they stand for. Each character is looked at a bounded number of times.
    """
    return " ".join(_words(_plain("".join(p for p, _ in _pieces(text, False))))).lower()


def marked_words(text: str) -> list[tuple[str, int]]:
    """The words of visible(), each with its marks: what a quote may pass over."""
    parts = [(_plain(p), mark) for p, mark in _pieces(text, True)]
    starts = list(accumulate((len(p) for p, _ in parts), initial=0))
    found, k = [], 0
    for m in _WORD.finditer("".join(p for p, _ in parts).lower()):
        while starts[k + 1] <= m.start():
            k += 1
        found.append((m[0], parts[k][1]))
    return found


_LINK = re.compile(
    r"""(?P<open>!?\[)|(?P<to>\]\(\s*(?P<url>https?://[^\s)]+)(?:\s+(?P<q>["'])(?P<title>[^\n"']*)(?P=q))?\s*\))"""
    r"""|(?P<shut>\])|<(?P<auto>https?://[^\s<>]+)>|(?P<bare>https?://[^\s)"'<>\[\]]+)"""
)
_GAP = re.compile(r"[^\S\n]+(?=[,.;:!?)\]\n]|\Z)|(?<=[^\S\n])[^\S\n]+")


def without_links(text: str) -> tuple[str, list[str]]:
    """A text in which links keep their label and title alone, and the URLs that went, in order. Blanks that are left at
    a line's end, before punctuation or side by side go, too; a text without URLs stays as it is."""
    if "http://" not in text and "https://" not in text:
        return text, []
    out: list[str] = []
    opened: list[int] = []
    urls: list[str] = []
    at = 0
    for m in _LINK.finditer(text):
        out.append(text[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if m["open"]:
            opened.append(len(out))
            out.append(m["open"])
        elif m["to"]:
            if opened:
                out[opened.pop()] = ""
            urls.append(m["url"])
            out.append(f" {m['title'] or ''}")
        elif kind == "shut":
            if opened:
                opened.pop()
            out.append("]")
        else:
            urls.append(m["auto"] or m["bare"])
            out.append(" ")
    out.append(text[at:])
    return _GAP.sub("", "".join(out)), urls


#: Of an Arrow batch (10,000 rows as Spark comes) so many rows at a time are Python objects: whole texts weigh much more as such.
SLICE = 256


def sliced(batch):
    """An Arrow array or batch in parts of SLICE rows, in order; nothing is copied."""
    return (batch.slice(k, SLICE) for k in range(0, len(batch), SLICE))


def by_slices(f, to: pa.DataType, batch: pa.Array) -> pa.Array:
    """f over each value of an array, as an array; null stays null."""
    parts = [pa.array([None if t is None else f(t) for t in part.to_pylist()], to) for part in sliced(batch)]
    return pa.concat_arrays(parts) if parts else pa.array([], to)


def over(f, kind: str, column: Column) -> Column:
    """f over each text of a column, batch by batch; null stays null."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(f, to, texts)

    to = pa.list_(pa.string()) if kind.startswith("array") else pa.string()
    return run(column.cast("string"))


def visible_text(c: Column) -> Column:
    """visible() of a column."""
    return over(visible, "string", c)


def strip_link_urls(c: Column) -> Column:
    """A column's texts without links: without_links()."""
    return over(lambda t: without_links(t)[0], "string", c)


def link_urls(c: Column) -> Column:
    """The URLs of a column's texts, in order."""
    return over(lambda t: without_links(t)[1], "array<string>", c)


def nfkc_each(c: Column) -> Column:
    """NFKC of each text of an array."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        fold = lambda t: t if t is None else unicodedata.normalize("NFKC", t)
        return by_slices(lambda x: [fold(t) for t in x], pa.list_(pa.string()), lists)

    return run(c)


def nfkc(c: Column) -> Column:
    """Compatibility forms (ligatures, full-width letters, ...) as what they stand for. Texts of ASCII alone stay in the JVM."""
    folded = over(lambda t: unicodedata.normalize("NFKC", t), "string", F.when(c.rlike(r"[^\x00-\x7F]"), c))
    return F.coalesce(folded, c)
