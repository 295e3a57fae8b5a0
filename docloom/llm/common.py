"""Spellings shared by the problems: split names, content hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.session import canonical_id

SPLITS = ("DEV", "REGRESSION", "FINAL_HOLDOUT")


def split_name(col):
    """Split in upper case without blanks around it; null where no split is named."""
    name = canonical_id(col)
    return F.when(name != "", name)


def hash_key(col):
    """The 64 hex digits of a content hash in lower case, whatever prefix precedes them; else null."""
    digits = F.regexp_extract(F.lower(col), r"(?:^|[^0-9a-f])([0-9a-f]{64})\s*$", 1)
    return F.when(digits != "", digits)


def group_key(col):
    key = canonical_id(col)
    return F.when(key != "", key)
