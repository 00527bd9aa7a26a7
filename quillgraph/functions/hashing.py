"""Choices that follow a hash which other engines give, too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*parts: Column | str | int) -> Column:
    """A number of 60 bits: the first 15 hex digits of the MD5 of the parts, joined by |; names are columns, numbers stand for themselves."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def stable_hash_sql(*parts: str) -> str:
    """The same in SQL, over expressions."""
    return f"cast(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) as bigint)"


def stable_hashes(texts: Iterable[bytes]) -> np.ndarray:
    """The same in Python, over the joined parts of many rows."""
    digests = b"".join([hashlib.md5(t, usedforsecurity=False).digest() for t in texts])
    return np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> np.uint64(4)
