"""Queries that have no SQL, against plain Python over the same tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

import __spark_entry__ as entry
from gradelake.functions.reader import INLINE, visible
from gradelake.functions.sections import split_sections
from gradelake.functions.text import STOP_WORDS
from gradelake.guard.inspect import pack_windows
from gradelake.plans.bridge import relation
from gradelake.plans.catalog import ALL

DONE = {
    "h6_visible_pages", "h8_detect_language", "h8_held_out_accuracy", "h28_classifier_windows", "k2_with_detector", "h24_tfidf_best_match", "h25_similarity_scores",
    "d32_coverage", "h26_readable_passages", "e12_pick_sections",
}


def test_none_is_left_out():
    assert {n for n, q in ALL.items() if not q.sql} == DONE


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: [r.asDict() for r in entry.queries()[name](spark, small).collect()]


@pytest.fixture(scope="module")
def rows(spark, small):
    return lambda name: [r.asDict() for r in relation(spark, small, name).collect()]


class Seen(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append("" if tag in INLINE else " ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.out.append("" if tag in INLINE else " ")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_decl(self, decl):
        self.out.append(f" {decl} ")  # a declaration is no tag: its words stay

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"https?://\S+", " ", data))


def test_pages_are_seen_as_a_parser_of_html_sees_them(run, rows):
    got = {r["page_id"]: r for r in run("h6_visible_pages")}
    for page in rows("pages"):
        parser = Seen()
        parser.feed(page["html"])
        parser.close()
        words = re.sub(r"[\W_]+", " ", "".join(parser.out)).strip().lower()
        assert got[page["page_id"]]["h"] == hashlib.sha256(words.encode()).hexdigest(), page["page_id"]
    assert len(got) == len(rows("pages"))


def test_languages_are_told_on_documents_not_learned_from(run):
    per = run("h8_held_out_accuracy")
    assert {r["lang"] for r in per} == {"en", "fr", "de", "es"} and sum(r["docs"] for r in per) > 20
    for r in per:
        assert r["right"] + r["unknown"] == r["docs"] and r["unknown"] <= 0.1 * r["docs"] + 1
    every = run("h8_detect_language")
    known = [r for r in every if r["nearest"] != "unknown"]
    assert sum(r["nearest"] == r["lang"] for r in known) >= 0.99 * len(known)
    assert all(r["detected"] == (r["nearest"] if r["nearest"] in ("en", "es", "unknown") else "other") for r in every)


def test_windows_and_scores(run, rows):
    want, best = set(), {}
    for d in rows("md_docs"):
        for k, w in enumerate(pack_windows(d["text"])):
            want.add((d["doc_id"], k, len(w), hashlib.sha256(w.encode()).hexdigest()))
        assert all(len(w) <= 1600 for w in pack_windows(d["text"])) and len(pack_windows(d["text"])) <= 48
    assert {(r["doc_id"], r["window"], r["n_chars"], r["h"]) for r in run("h28_classifier_windows")} == want
    for d in rows("documents"):
        scores = [min(1.0, w.count("e") / max(1, len(w)) * 5) for w in pack_windows(d["text"])]
        if scores:
            best[d["doc_id"]] = max(scores)
    got = {r["doc_id"]: r for r in run("k2_with_detector")}
    assert {k: r["score"] for k, r in got.items()} == pytest.approx(best)
    assert all(r["flagged"] == (r["score"] >= 0.5) and r["blocked"] == (r["score"] >= 0.9) for r in got.values())


def grams(text):
    words = [w for w in re.sub(r"[\W_]+", " ", text).lower().split(" ") if len(w) > 1 and w not in STOP_WORDS]
    words = [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words]
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def vectors(texts, corpus):
    df = Counter(t for c in corpus for t in grams(c))
    out = []
    for text in texts:
        w = {t: (1 + math.log(n)) * math.log(1 + max(1, len(corpus)) / (1 + df[t])) for t, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()} if norm else {})
    return out


def dot(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


def test_tfidf_and_similarity(run, rows):
    talk = rows("conversations")
    groups = defaultdict(list)
    for c in talk:
        groups[c["conv_id"] % 8].append(c["text"])
    best = {}
    for b in rows("benchmark"):
        corpus = groups[b["item_id"] % 8]
        (own,), others = vectors([b["text"]], corpus), vectors(corpus, corpus)
        best[str(b["item_id"])] = max((dot(own, o) for o in others), default=0.0)
    assert {r["id"]: r["best"] for r in run("h24_tfidf_best_match")} == pytest.approx(best, abs=2e-6)
    asked, chunks = defaultdict(list), defaultdict(list)
    for c in talk:
        {"user": asked, "assistant": chunks}.get(c["role"], defaultdict(list))[c["conv_id"] % 40].append(c["text"])
    got = {r["doc_id"]: r for r in run("h25_similarity_scores")}
    for doc, r in got.items():
        q, c = vectors(asked[doc], chunks[doc]), vectors(chunks[doc], chunks[doc])
        assert r["relevance"] == pytest.approx(sum(max((dot(a, b) for b in c), default=0.0) for a in q) / len(q), abs=2e-6)
        assert r["question_diversity"] == pytest.approx(1 - max((dot(a, b) for i, a in enumerate(q) for b in q[:i]), default=0.0), abs=2e-6)
    assert len(got) >= 5


def test_sections_passages_and_coverage(run, rows):
    docs = rows("md_docs")
    passages = Counter()
    for d in docs:
        for _, _, text, tokens in split_sections(d["text"]):
            if tokens >= 20:
                words = [visible(p).split() for p in re.split(r"\n\s*\n", text)]
                passages.update((d["doc_id"], " ".join(w[:120])) for w in words if len(w) >= 6)
    assert Counter((r["doc_id"], r["passage"]) for r in run("h26_readable_passages")) == passages
    covered = {}
    for d in docs:
        text = d["text"] + "\n## Part C\n" + d["text"]
        quote = visible(" ".join(text.split(" ")[3:9]))
        some = [visible(t) for _, _, t, n in split_sections(text) if n >= 40]
        if len(some) >= 3:
            covered[d["doc_id"]] = min(1.0, sum(quote in t for t in some) / 1)
    assert {r["doc_id"]: r["coverage"] for r in run("d32_coverage")} == pytest.approx(covered)
    picked = set()
    for d in docs:
        some = [(k, t) for k, (_, _, t, n) in enumerate(split_sections(d["text"])) if n >= 40]
        words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if len(w) > 2]
        scores = [sum(w in ("part", "the", "doc") for w in words(t)) for _, t in some]
        if some:
            best = max(range(len(some)), key=lambda i: (scores[i], -i)) if max(scores) else math.floor(0.5 * len(some))
            picked.add((d["doc_id"], some[best][0]))
    assert {(r["doc_id"], r["section"]) for r in run("e12_pick_sections")} == picked
