"""Model ids to providers, and call errors to kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and prefixes of one family, error codes and statuses.
META_NAMES = ("muse spark 1.1", "muse-spark-1.1")
META_PREFIXES = ("muse-", "meta-muse-", "meta/muse-")
FATAL_CODES = ("insufficient_quota", "invalid_api_key", "account_deactivated", "invalid_organization", "billing_not_active")
FATAL_STATUSES = (401, 402, 403)
RETRYABLE_STATUSES = (429, 500, 502, 503)


def strip(x: Column) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def target_provider(model: Column) -> Column:
    """anthropic, meta, openrouter or openai, the first whose rule holds."""
    name = F.lower(strip(model))
    meta = name.isin(*META_NAMES)
    for prefix in META_PREFIXES:
        meta = meta | F.startswith(name, F.lit(prefix))
    return F.when(F.startswith(model, F.lit("claude")), "anthropic").when(meta, "meta").when(F.contains(model, F.lit("/")), "openrouter").otherwise("openai")


def judge_provider(model: Column) -> Column:
    """openai, anthropic or openrouter for a judge; null for an unknown one."""
    starts = lambda p: F.startswith(model, F.lit(p))
    return F.when(starts("gpt-") | starts("o"), "openai").when(starts("claude-"), "anthropic").when(F.contains(model, F.lit("/")), "openrouter")


def canonical_model(model: Column) -> Column:
    return F.when(F.lower(strip(model)) == META_NAMES[0], META_NAMES[1]).otherwise(strip(model))


def error_kind(code: Column, status: Column) -> Column:
    """fatal, retryable or other for a call error by its code and HTTP status; null without an error."""
    none = code.isNull() & status.isNull()
    fatal = F.coalesce(code.isin(*FATAL_CODES), F.lit(False)) | F.coalesce(status.isin(*FATAL_STATUSES), F.lit(False))
    return F.when(none, F.lit(None)).when(fatal, "fatal").when(F.coalesce(status.isin(*RETRYABLE_STATUSES), F.lit(False)), "retryable").otherwise("other")
