"""Identifiers and pseudonyms: log ids, salted hashes, PII masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default salt and the two masking patterns.
DEFAULT_SALT = "default_normalization_salt_2026"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
NAMED_TOKEN = r"""(?iU)\b(user|for|login)[\s\x1c-\x1f=:]+([^\s\x1c-\x1f,;\[\]"'()]+)"""


def log_id(line: Column) -> Column:
    """SHA-256 of the line: the same line always gets the same id."""
    return F.sha2(line, 256)


def pseudonym(value: Column, salt: str = DEFAULT_SALT) -> Column:
    """First 16 hex digits of the salted SHA-256; NULL and '' stay as they are."""
    hashed = F.substring(F.sha2(F.concat(value, F.lit(salt)), 256), 1, 16)
    return F.when(value == "", value).otherwise(hashed)


def _replace_matches(text: Column, pattern: str, replace) -> Column:
    """Put ``replace(match)`` in place of every match, keeping the gaps between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(
            F.concat(F.array(F.lit("")), F.transform(matches, replace)),
            gaps,
            lambda done, gap: F.concat(F.coalesce(done, F.lit("")), F.coalesce(gap, F.lit(""))),
        ),
        "",
    )


def mask_emails(text: Column, salt: str = DEFAULT_SALT) -> Column:
    masked = _replace_matches(text, EMAIL, lambda m: pseudonym(m, salt))
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def mask_named_tokens(text: Column, salt: str = DEFAULT_SALT) -> Column:
    """Hash the token after user/for/login; what stood between becomes one space."""

    def replace(match: Column) -> Column:
        token = F.regexp_extract(match, NAMED_TOKEN, 2)
        return F.concat(F.regexp_extract(match, NAMED_TOKEN, 1), F.lit(" "), pseudonym(token, salt))

    masked = _replace_matches(text, NAMED_TOKEN, replace)
    return F.when(F.regexp_like(text, F.lit(NAMED_TOKEN)), masked).otherwise(text)


def mask_pii(text: Column, salt: str = DEFAULT_SALT) -> Column:
    """Hash e-mail addresses, then the token after each of user/for/login."""
    return mask_named_tokens(mask_emails(text, salt), salt)
