"""What of a document may be trusted: its parts that give orders, and the words, hosts and markup outside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.guard.inspect import TAG, flagged_segments, instructions
from gradelake.guard.rules import MARKUP

TOKEN = re.compile(r"[^\W_]{3,}")
#: Letters and digits in one word, perhaps with hyphens: how a mark looks that is to be found again.
COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
URL = re.compile(r"https?://[^\s)\"'<>\]]+")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
#: Tags that load or run something, and schemes that do.
ACTIVE_TAGS = frozenset("script iframe object embed img svg style link meta form input".split())
SCHEME = re.compile(r"javascript:|data:\s*text/html", re.I)
HANDLER = re.compile(r"\s(on[a-z]{3,})\s*=", re.I)
#: Words of any quiz, which an instruction of a document can't plant; words of every URL.
QUIZ_WORDS = frozenset(
    "question questions answer answers option options correct explanation quiz document text every each first following "
    "pregunta preguntas respuesta respuestas opción opciones correcta explicación documento texto cada "
    "pergunta perguntas resposta respostas opção opções explicação".split()
)
URL_WORDS = frozenset("http https www".split())
SCHEMA = (
    "strict boolean, hosts array<string>, planted array<string>, marks array<string>, markup array<string>, "
    "orders array<string>, text_lang string"
)


def tokens(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def marks(text: str) -> set[str]:
    """Parts of words that mix letters and digits."""
    mixed = (w for w in COMPOUND.findall(text.lower()) if re.search(r"\d", w) and re.search(r"[^\W\d_]", w))
    return {t for w in mixed for t in TOKEN.findall(w)}


def hosts(text: str) -> set[str]:
    return set(HOST.findall(text.lower()))


def active_markup(text: str) -> set[str]:
    """What a text holds that a browser or a chat model would act on, by name: tags, handlers, schemes, chat markers."""
    found = {m[0].lower() for m in MARKUP.finditer(text)} | {re.sub(r"\s", "", m[0].lower()) for m in SCHEME.finditer(text)}
    for m in TAG.finditer(text):
        found |= {m[2].lower()} & ACTIVE_TAGS
        found |= {h.lower() for h in HANDLER.findall(m[3])}
    return found


def _facts(text: str) -> tuple:
    segments = flagged_segments(text)
    clean = text
    for s in segments:
        clean = clean.replace(s, " ")
    said, known = "\n".join(segments), tokens(clean)
    orders = {r.id for _, r in instructions(text) if r.imperative}
    return bool(segments), *(sorted(x) for x in (hosts(clean), tokens(said) - known, marks(said) - known, active_markup(text), orders))


def provenance(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str | None = None) -> DataFrame:
    """One row a document: key, strict (some part gives an order), hosts named outside such parts, words that stand in
    them alone (planted) and those of them that look like marks, active markup and orders of the whole text, its language.

    A null text trusts and plants nothing. Each document is read once, on its own; the sets travel on without the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")][:-1]
        for b in batches:
            facts = pd.DataFrame([_facts(t or "") for t in b["t"]], columns=names, index=b.index)
            yield pd.concat([b[[key]], facts, b[["text_lang"]]], axis=1)

    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = docs.select(key, F.col(text).alias("t"), language.alias("text_lang"))
    return rows.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {SCHEMA}")


def planted_words(facts: DataFrame, common: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, word): words that only an order of a document has. Words of any quiz and common(word) are none, unless they
    are part of a mark (letters with digits)."""
    rows = facts.select(key, "marks", F.explode("planted").alias("word"))
    rows = rows.withColumn("mark", F.array_contains("marks", F.col("word"))).drop("marks")
    rows = rows.where(F.col("mark") | ~F.col("word").isin(*QUIZ_WORDS))
    if common is not None:
        every = common.select(F.lower("word").alias("w")).distinct().withColumn("known", F.lit(True))
        rows = rows.join(every, F.col("word") == F.col("w"), "left").where("mark or known is null")
    return rows.select(key, "word")
