"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier learns from the result."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import cut

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "secret")
#: Top-level domains that labelers take for a sign of an address.
DOMAINS = frozenset("com org net edu gov int info biz io co de fr es pt it nl eu uk us ca au br mx ch at be pl ru jp cn in".split())
#: First digits of payment cards and of international dialling codes.
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
DIALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "64", "65", "7", "81", "82", "86", "90", "91")
#: Words that announce personal data, in the corpus's languages.
CONTEXT = re.compile(r"(?i)\b(e-?mail|mail|correo|courriel|phone|tel|call|fax|mobile|m[oó]vil|tel[eé]fono|t[eé]l[eé]phone|telefon|card|visa|tarjeta|carte|karte|ssn|iban|passport|pasaporte|ausweis|password|passwd|pwd|contrase[nñ]a|passwort|secret|token|api[_-]?key|address|user|login)\b\W{0,4}(?:\w+\W{1,3}){0,2}\Z")
MARK = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't start within digits: it would have started before them. Saying so keeps long runs of digits from being read again and again.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What the labelers look at besides the base spans: strings with a digit or an at sign, and groups of digits with single spaces between them.
TOKEN = re.compile(r"[^\s<>\"',;]++")
DIGITS = re.compile(r"[0-9().-]++")
ASSIGNED = ("pass", "pwd", "secret", "token", "key")
SECRET = re.compile(r"[A-Z]{4}[A-Z0-9]{12,}\Z|(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,}\Z")
NAMED = re.compile(r"([A-Za-z_]++)[=:]\S{6,}\Z")
NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z|[0-9]{8}[A-Z]\Z|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{4}){2,}\Z")
PLAIN = re.compile(r"[(v]?[0-9]{1,6}(?:[.,:/-][0-9]{1,6}){0,2}[).%]*\Z")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each base kind; matches that fail its test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if not MARK.search(text):
        return out
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at  # only the run of local characters before an at sign can be a local part
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _regex(kind: str, s: str) -> int:
    return 1 if kind in BASE else 0


def _gazetteer(kind: str, s: str) -> int:
    digits = "".join(c for c in s if c.isdigit())
    if "@" in s:
        return 1 if s.rpartition(".")[2].lower() in DOMAINS else 0
    if s.startswith("+"):
        return 1 if digits.startswith(DIALLING) else -1
    return 1 if 16 <= len(digits) <= 19 and digits.startswith(ISSUERS) else 0


def _national(kind: str, s: str) -> int:
    return 1 if NATIONAL.match(s) else 0


def is_secret(s: str) -> bool:
    """A key or hash by its shape, or a value given to a name like password."""
    named = NAMED.match(s)
    return bool(SECRET.match(s) or named and any(w in named[1] for w in ASSIGNED))


def _secret(kind: str, s: str) -> int:
    return 1 if is_secret(s) else 0


def _plain(kind: str, s: str) -> int:
    return -1 if PLAIN.match(s) else 0


def _digits(kind: str, s: str) -> int:
    n = sum(c.isdigit() for c in s)
    return -1 if n < 6 and not re.search("[A-Za-z@]", s) else 1 if n >= 8 and kind == "number" and re.search(r"[0-9][ .()-]+[0-9]", s) else 0


def _checksum(kind: str, s: str) -> int:
    digits = s.replace(" ", "").replace("-", "")
    return 0 if not (digits.isascii() and digits.isdigit() and 16 <= len(digits) <= 19) else 1 if luhn(digits) else -1


LABELERS = (_regex, _gazetteer, _national, _secret, _plain, _digits, _checksum)


def strings(text: str) -> Iterator[tuple[int, int]]:
    """Where strings with a digit or an at sign lie; neighbours made of digits, brackets, points and hyphens, with one space between them, are one. Linear in the text."""
    group: tuple[int, int] | None = None
    for m in TOKEN.finditer(text):
        a, b = m.span()
        marked = MARK.search(text, a, b)
        digits = marked and DIGITS.fullmatch(text, a, b)
        if group and not (digits and a == group[1] + 1 and text[a - 1] == " "):
            yield group
            group = None
        if digits:
            group = (group[0] if group else a, b)
        elif marked:
            yield a, b
    if group:
        yield group


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes): base spans and what else might be personal data, with each labeler's vote (1: yes, -1: no, 0: none); the last is the context's."""
    if not MARK.search(text):
        return []
    taken: list[tuple[int, int]] = []  # united, so that one search tells whether a span overlaps any
    for x, y in sorted(s for spans in base.values() for s in spans):
        if taken and x < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(y, taken[-1][1]))
        else:
            taken.append((x, y))
    starts = [x for x, _ in taken]
    found = [(k, a, b) for k in BASE for a, b in base[k]]
    for a, b in strings(text):
        while b > a and text[b - 1] in ".:!?)-(":
            b -= 1
        k = bisect_left(starts, b) - 1
        if b > a and not (k >= 0 and taken[k][1] > a):
            s = text[a:b]
            found.append(("email" if "@" in s else "secret" if is_secret(s) else "number", a, b))
    out, known = [], {(k, *span) for k in BASE for span in base[k]}
    for kind, a, b in found:
        s = text[a:b]
        is_base = (kind, a, b) in known
        votes = [f(kind if is_base or kind not in BASE else "", s) for f in LABELERS]
        out.append((kind, a, b, (*votes, 1 if CONTEXT.search(text[max(0, a - 40) : a]) else 0)))
    return out


#: Classes of characters, and all words that features() can say.
CLASSES = tuple("dUl@.-+()= :_/x")
VOCABULARY = (
    *(f"k={k}" for k in KINDS), *(f"n={i}" for i in range(9)), *(f"d={i}" for i in range(21)), *(f"a={i}" for i in range(9)), *(f"s={i}" for i in range(5)),
    *(f"c={'space' if c == ' ' else c}" for c in CLASSES), *(f"v{i}={v}" for i in range(len(LABELERS) + 1) for v in (1, -1)),
)


def features(kind: str, s: str, votes: tuple[int, ...]) -> str:
    """What the classifier sees of a span, as words of VOCABULARY: its kind, shape and votes."""
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    held = {"d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else c if c in "@.-+()= :_/" else "x" for c in s}
    share = round(4 * digits / max(1, len(s)))
    words = [f"k={kind}", f"n={min(8, len(s).bit_length())}", f"d={min(20, digits)}", f"a={min(8, letters.bit_length())}", f"s={share}"]
    return " ".join(words + [f"c={'space' if c == ' ' else c}" for c in CLASSES if c in held] + [f"v{i}={v}" for i, v in enumerate(votes) if v])


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of being personal data for each vote pattern, given how often it occurs (after Dawid and Skene, 1979).

    A labeler has one reliability, how often its votes are right; no vote says nothing. Reliabilities start at 0.8, weigh as 10 votes there, and stay within 0.55 and 0.99.
    """
    p, voted = np.full(len(votes), 0.5), votes != 0
    for _ in range(rounds):
        right = np.where(votes > 0, p[:, None], 1 - p[:, None]) * voted if _ else 0.8 * voted
        reliability = np.clip(((right * counts[:, None]).sum(axis=0) + 8) / ((voted * counts[:, None]).sum(axis=0) + 10), 0.55, 0.99)
        prior = np.clip(((p * counts).sum() + 5) / (counts.sum() + 10), 0.2, 0.5)
        new = 1 / (1 + np.exp(-(votes * np.log(reliability / (1 - reliability))).sum(axis=1) - math.log(prior / (1 - prior))))
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return p


@dataclass
class Classifier:
    weights: dict[str, float]
    intercept: float

    def score(self, words: str) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + sum(self.weights.get(w, 0.0) for w in words.split())))))


def learn(patterns: DataFrame, posterior: dict[str, float], ridge: float = 1e-4, rounds: int = 100) -> Classifier:
    """Logistic regression on patterns (f: features, v: votes, n: count), all of them, by Newton's method with step halving.

    A pattern weighs as the root of its count. Spark sums loss, gradient and curvature over the patterns; the driver holds one square matrix over VOCABULARY, whatever their number.
    """
    size, at = len(VOCABULARY) + 1, {w: i for i, w in enumerate(VOCABULARY)}
    total = patterns.agg(F.sum(F.sqrt("n"))).first()[0]
    if not total:
        return Classifier({}, 0.0)

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, bend = 0.0, np.zeros(size), np.zeros((size, size))
            for whole in batches:
                for k in range(0, whole.num_rows, 4096):
                    b = whole.slice(k, 4096)
                    x = np.zeros((b.num_rows, size))
                    x[:, -1] = 1
                    for i, f in enumerate(b.column(0).to_pylist()):
                        x[i, [at[w] for w in f.split()]] = 1
                    y, n = np.array([posterior[v] for v in b.column(1).to_pylist()]), np.sqrt(b.column(2).to_numpy()) / total
                    z = x @ theta
                    q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    loss += float((n * (np.logaddexp(0, z) - y * z)).sum())
                    slope += x.T @ (n * (q - y))
                    bend += (x * (n * q * (1 - q))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[loss], slope, bend.ravel()]).tobytes()], pa.binary())], ["sums"])

        got = sum(np.frombuffer(r["sums"]) for r in patterns.select("f", "v", "n").mapInArrow(run, "sums binary").toLocalIterator())
        return float(got[0]), got[1 : size + 1], got[size + 1 :].reshape(size, size)

    pull = np.append(np.full(size - 1, ridge), 1e-9)
    theta, best, least = np.zeros(size), np.zeros(size), math.inf
    for _ in range(rounds):
        loss, slope, bend = sums(theta)
        loss += float((pull * theta * theta).sum()) / 2
        if loss > least + 1e-12:
            theta = (theta + best) / 2
            continue
        best, least = theta, loss
        step = np.linalg.solve(bend + np.diag(pull), slope + pull * theta)
        if np.abs(step).max() < 1e-4:
            break
        theta = theta - step
    return Classifier(dict(zip(VOCABULARY, map(float, best))), float(best[-1]))


def fit(docs: DataFrame, text_col: str = "text") -> Classifier:
    """A span classifier learned from all candidates of all documents.

    Spark counts candidates by features and votes. Expectation-maximisation runs on the driver over counts by votes alone, at most 3 to the power of the labelers; the classifier's sums stay in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(features(k, t[s:e], v), ",".join(map(str, v))) for t in b.column(0).to_pylist() if t for k, s, e, v in candidates(t, base_spans(t))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], ["f", "v"])

    marked = docs.select(F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike("[0-9@]"))
    patterns = cut(marked.mapInArrow(run, "f string, v string").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")), "patterns")
    rows = patterns.groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect()
    votes = np.array([[int(x) for x in r["v"].split(",")] for r in rows], int).reshape(len(rows), len(LABELERS) + 1)
    posterior = expectation_maximisation(votes, np.array([r["n"] for r in rows], float)) if len(rows) else np.zeros(0)
    return learn(patterns, {r["v"]: float(p) for r, p in zip(rows, posterior)})


def find(text: str, model: Classifier, threshold: float = 0.5) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind and start: the base ones and what the classifier adds."""
    base = base_spans(text)
    known = {(k, a, b) for k in BASE for a, b in base[k]}
    spans = [*known]
    spans += [(k, a, b) for k, a, b, v in candidates(text, base) if (k, a, b) not in known and model.score(features(k, text[a:b], v)) >= threshold]
    return base, sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one, under the first one's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def annotate(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), mask: bool = False) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points), with mask also the masked text; carry names further columns to return.

    A null text is empty and has no spans. Each row is read on its own, whole, so repeated rows, null ids, long texts and columns of any name change nothing; an empty table gives no rows.
    """
    kept = docs.select(F.col(id_col), *carry, F.col(text_col).cast("string").alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                got = [find(t or "", model) for t in texts]
                counts = [pa.array([len(base[k]) for base, _ in got], pa.int64()) for k in BASE]
                sha = [hashlib.sha256(_joined([(k, x, y) for k in BASE for x, y in base[k]]).encode()).hexdigest() for base, _ in got]
                arrays = [*part.columns[:-1], *counts, pa.array(sha, pa.string()), pa.array([_joined(s) for _, s in got], pa.string())]
                names = [*part.schema.names[:-1], *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
                if mask:
                    arrays, names = [*arrays, pa.array([t and masked(t, s) for t, (_, s) in zip(texts, got)], pa.string())], [*names, "masked"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return kept.mapInArrow(run, schema)
