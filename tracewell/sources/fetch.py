"""Fetching of distinct sources, each once, with retries and a cache.

Keys are made distinct and dealt out; a task fetches its keys one by one. What is fetched
goes to the cache under the digest of its address: written beside and put in place at
once, so a cache file is whole or not there, and a task that runs again fetches only what
is missing. A key that can't be fetched gives a row with the error; it fails nothing else.
"""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

# Seconds between tries, which double up to the second one, and for one try.
FIRST_WAIT, LONGEST_WAIT, TIMEOUT = 1.0, 8.0, 45


class FetchError(OSError):
    """An answer that is no content."""


def address(template: str, key: dict[str, str]) -> str:
    """The template with `{name}` in place of each part of a key, quoted but for slashes."""
    return template.format(**{n: "/".join(urllib.parse.quote(p, safe="") for p in str(v).split("/")) for n, v in key.items()})


def fetch(url: str, folder: str, tries: int = 4, first_wait: float = FIRST_WAIT, opened=None, slept=time.sleep) -> tuple[bytes, int]:
    """(content, tries taken; 0 from the cache) of an address; FetchError after the last try."""
    place = os.path.join(folder, hashlib.sha256(url.encode()).hexdigest())
    try:
        with open(place, "rb") as f:
            if content := f.read():
                return content, 0
    except FileNotFoundError:
        pass
    os.makedirs(folder, exist_ok=True)
    opened = opened or (lambda u: urllib.request.urlopen(u, timeout=TIMEOUT))
    last: Exception | None = None
    for i in range(tries):
        try:
            with opened(url) as answer:
                content = answer.read()
            if not content:
                raise FetchError("empty answer")
            beside = f"{place}.{uuid.uuid4().hex}"
            with open(beside, "wb") as f:
                f.write(content)
            os.replace(beside, place)
            return content, i + 1
        except (OSError, urllib.error.URLError, ValueError) as e:
            last = e
            if i + 1 < tries:
                slept(min(first_wait * 2**i, LONGEST_WAIT))
    raise FetchError(f"{url}: {last}")


def fetched(keys: DataFrame, template: str, folder: str, tries: int = 4, first_wait: float = FIRST_WAIT) -> DataFrame:
    """The distinct rows of keys (text columns) with content, error and tries; folder must be shared by all executors."""
    if tries < 1:
        raise ValueError("at least one try")
    folder = folder.removeprefix("file://")
    names = keys.columns

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            rows = []
            for values in b.itertuples(index=False):
                try:
                    rows.append((*fetch(address(template, dict(zip(names, values, strict=True))), folder, tries, first_wait), None))
                except FetchError as e:
                    rows.append((None, tries, f"source_fetch_error: {e}"))
            yield b.assign(content=[r[0] for r in rows], tries=[r[1] for r in rows], error=[r[2] for r in rows])

    ship(keys.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    return keys.distinct().mapInPandas(run, f"{fields}, content binary, tries int, error string")
