"""Harvests and downloads, with the network as a function that comes in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged_harvest(fetch: Callable[[str | None], tuple[DataFrame, str | None]], path: str, token: str | None = None, tries: int = 3, wait: float = 0.0) -> tuple[int, str | None]:
    """Appends page after page to a folder of JSON lines, and returns (pages, the token to go on with).

    fetch(token) returns a page's records (xml) and the next page's token, None at
    the end. A page that fails `tries` times ends the harvest; its token is
    returned, so that a later call goes on there.
    """
    pages = 0
    while True:
        for attempt in range(tries):
            try:
                records, after = fetch(token)
                break
            except OSError:
                if attempt + 1 == tries:
                    return pages, token
                time.sleep(wait)
        records.select(F.to_json(F.struct("xml")).alias("value")).write.mode("append").text(path)
        pages, token = pages + 1, after
        if token is None:
            return pages, None


def downloaded(ids: DataFrame, fetch: Callable[[str], bytes], largest: int, tries: int = 3) -> DataFrame:
    """(id, content, error) of ids (id): what fetch returns, or why there is none; content over `largest` bytes is left out."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                content, error = None, None
                for _ in range(tries):
                    try:
                        content, error = fetch(i), None
                        break
                    except OSError as e:
                        error = str(e) or type(e).__name__
                if content is not None and len(content) > largest:
                    content, error = None, f"over {largest} bytes"
                yield pd.DataFrame({"id": [i], "content": [content], "error": [error]})

    return ids.select("id").mapInPandas(get, "id string, content binary, error string")
