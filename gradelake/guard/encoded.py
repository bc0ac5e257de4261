"""Encoded runs of a text and what they say: base64, hexadecimal, percent, escapes, entities, binary.

A text is cut at its white space; a token is looked at as a whole, and within it runs of an alphabet are taken from their
first to their last character. Each character is looked at a bounded number of times, however long a token is.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

#: Shorter tokens encode nothing worth reading; so many encoded characters make a run.
LEAST_TOKEN, LEAST_RUN, LEAST_PERCENT, LEAST_ESCAPES, LEAST_ENTITIES, LEAST_BYTES = 20, 24, 3, 6, 8, 8
#: A decoded text has so many characters at least, and this share of them are letters, digits, blanks or punctuation.
LEAST_DECODED, PRINTABLE = 8, 0.9
_TOKEN = re.compile(rf"\S{{{LEAST_TOKEN},}}")
_ALPHABET = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})")
_PERCENT = re.compile(r"%[0-9a-fA-F]{2}")
_ENTITY = re.compile(r"&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});")
_BITS = re.compile(rf"(?<![0-9A-Za-z])[01]{{8}}(?:[ ,]?[01]{{8}}){{{LEAST_BYTES - 1},}}(?![0-9A-Za-z])")


def from_base64(run: str) -> str | None:
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4)).decode()
    except (ValueError, binascii.Error):
        return None


def _from_hex(run: str) -> str | None:
    try:
        return bytes.fromhex(run[: len(run) // 2 * 2]).decode()
    except ValueError:
        return None


def readable(text: str | None) -> bool:
    if not text or len(text) < LEAST_DECODED:
        return False
    fine = sum(c.isalnum() or c.isspace() or unicodedata.category(c)[0] in "PS" for c in text)
    return fine >= PRINTABLE * len(text)


def _of_token(token: str) -> Iterator[tuple[str, str | None]]:
    if token.count("%") >= LEAST_PERCENT and len(_PERCENT.findall(token)) >= LEAST_PERCENT:
        try:
            yield "percent", unquote(token, errors="strict")
        except UnicodeDecodeError:
            pass
    if "\\" in token and len(found := _ESCAPE.findall(token)) >= LEAST_ESCAPES:
        yield "escapes", "".join(chr(int(e[2:], 16)) for e in found)
    if "&#" in token and len(found := _ENTITY.findall(token)) >= LEAST_ENTITIES:
        yield "entities", html.unescape("".join(found))
    for m in _ALPHABET.finditer(token):
        run = m[0].rstrip("=")
        if _HEX.fullmatch(run):
            yield "hex", _from_hex(run)
            continue
        whole = from_base64(run)
        yield "base64", whole
        if not whole and "/" in run:  # a path before or after it
            yield from (("base64", from_base64(part)) for part in run.split("/") if len(part) >= LEAST_RUN)


def candidates(text: str) -> list[tuple[str, str]]:
    """(encoding, decoded text) of the runs that decode to something readable."""
    out = [(kind, d) for m in _TOKEN.finditer(text) for kind, d in _of_token(m[0]) if d and readable(d)]
    for m in _BITS.finditer(text):
        bits = re.sub("[ ,]", "", m[0])
        d = "".join(chr(int(bits[i : i + 8], 2)) for i in range(0, len(bits), 8))
        out += [("binary", d)] if readable(d) else []
    return out
