"""Redaction of personal and secret data as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (replacement, pattern), in the order in which they are applied.
PATTERNS = [
    ("[EMAIL]", r"[\w.+-]+@[\w-]+\.[\w.-]+\w"), ("[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"), ("[CARD]", r"\b(?:\d{4}[ -]){3}\d{4}\b"),
    ("[PHONE]", r"\b\d{3}[-.]\d{3}[-.]\d{4}\b"), ("[IP]", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
]
SECRET_PARAMETERS = r"(?i)([?&](?:api_?key|token|secret|password|access_token|signature)=)[^&#]*"


def redacted(text: Column) -> Column:
    """The text with e-mail addresses, numbers of persons, cards and phones, and IP addresses replaced; null stays null."""
    for mark, pattern in PATTERNS:
        text = F.regexp_replace(text, pattern, F.lit(mark))
    return text


def redacted_url(url: Column) -> Column:
    """The URL with the values of secret parameters replaced."""
    return F.regexp_replace(url, SECRET_PARAMETERS, "$1REDACTED")


def has_personal_data(text: Column) -> Column:
    """Whether any pattern of personal data occurs; null counts as none."""
    found = F.lit(False)
    for _, pattern in PATTERNS:
        found = found | F.coalesce(text.rlike(pattern), F.lit(False))
    return found


def pseudonym(value: Column) -> Column:
    """A stable stand-in for a personal value: the first 16 digits of its SHA-256; null stays null."""
    return F.substring(F.sha2(value, 256), 1, 16)
