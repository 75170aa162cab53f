"""Kinds of error messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_LIMIT = r"429|too many requests|rate limit exceeded"
#: Words that point to the provider (fixed values).
PROVIDER = "provider|tokenrouter|gemini|groq|api key|suggestion|quota|rate limit|429|401|503"


def is_rate_limit(message: Column, code: Column | None = None) -> Column:
    found = F.coalesce(F.lower(message).rlike(RATE_LIMIT), F.lit(False))
    return found if code is None else found | F.coalesce(code == 429, F.lit(False))


def is_provider_issue(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(PROVIDER), F.lit(False))
