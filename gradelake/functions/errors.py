"""Stored failures as users see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which failure text means which kind; the first that matches holds.
ERROR_PATTERNS = (
    ("host", r"(?i)host not allowed:\s*(\S+)"),
    ("too_large", r"(?i)exceeds \d+ bytes|too_large"),
    ("invalid_url", r"(?i)not a valid URL|only https|credentials in URL|custom ports"),
    ("unreadable", r"(?i)document is empty|has no usable sections|unexpected content-type"),
    ("not_found", r"(?i)source returned HTTP 404"),
    ("not_text", r"(?i)not_text:"),
    ("classifier", r"(?i)the classifier scored"),
    ("unsafe", r"(?i)unsafe_document"),
    ("language", r"(?i)unsupported_language"),
    ("invalid_input", r"(?i)invalid_llm_input"),
    ("unreliable", r"(?i)QualityGateError|StructuredOutputError|UnsafeOutputError|unsafe_output|not grounded|grounded question"),
    ("budget", r"(?i)budget exceeded"),
    ("timeout", r"(?i)timed out"),
)


#: What users are told, by kind; {host} is the host that was refused.
MESSAGES = {
    "host": 'The host "{host}" is not allowed. Use a Markdown file hosted on github.com or raw.githubusercontent.com.',
    "too_large": "That document is too large (limit 512 KB). Try a shorter one.",
    "invalid_url": "That is not a valid https document URL.",
    "unreadable": "That URL does not contain a readable Markdown/text document.",
    "not_found": "The document was not found (HTTP 404). Check the URL.",
    "not_text": "That link does not point to a text document (it looks like a binary file). Use a Markdown or text file.",
    "classifier": (
        "Our prompt-injection classifier rejected this document. If it is a legitimate README, you can ask for it to be "
        "reviewed and added to the document list."
    ),
    "unsafe": "This document contains hidden or encoded text, so it was rejected for safety. Remove it and try again.",
    "language": "This document is not in a supported language. Supported: English, Portuguese and Spanish.",
    "invalid_input": "This request could not be processed safely. Check the topic and the document.",
    "unreliable": "The AI could not produce a reliable quiz from this document. Please try again.",
    "budget": "This document is too large or complex to process within our limits. Try a shorter one.",
    "timeout": "Generation took too long. Please try again.",
    "other": "Quiz generation failed. Please try again.",
}


def user_message(raw: Column) -> Column:
    """What a user is told of a stored failure; null and empty stay null."""
    told = F.element_at(F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair)), error_kind(raw))
    return F.replace(told, F.lit("{host}"), F.coalesce(refused_host(raw), F.lit("")))


def error_kind(raw: Column) -> Column:
    """Kind of a failure text; null stays null, anything else is `other`."""
    out = None
    for kind, pattern in ERROR_PATTERNS:
        out = F.when(raw.rlike(pattern), kind) if out is None else out.when(raw.rlike(pattern), kind)
    return F.when(raw.isNotNull() & (raw != ""), out.otherwise("other"))


def refused_host(raw: Column) -> Column:
    """The host named by a `host not allowed` failure, else null."""
    return F.nullif(F.regexp_extract(raw, ERROR_PATTERNS[0][1], 1), F.lit(""))


def classifier_finding(raw: Column) -> Column:
    """(score, excerpt) of a refusal by the classifier, else null: the text after `— excerpt:` or else the whole, trimmed, 500 characters at most."""
    score = F.regexp_extract(raw, r"the classifier scored ([0-9.]+)", 1)
    found = F.regexp_extract(raw, r"(?s)— excerpt: (.+)$", 1)
    excerpt = F.substring(F.trim(F.when(found != "", found).otherwise(raw)), 1, 500)
    return F.when(score != "", F.struct(score.try_cast("double").alias("score"), excerpt.alias("excerpt")))
