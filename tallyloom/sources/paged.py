"""SRC-10/16: paged sources read through an injected transport, with a cache of raw responses and an account of requests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a transport returns for a URL: status, body (None without one) and error (None without one).
Transport = Callable[[str], tuple[int, str | None, str | None]]
RESPONSE = "resource string, page int, url string, cache_key string, status int, error string, sha256 string, body string, more boolean"


def cache_key(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:20]


def read_pages(resources: DataFrame, transport: Transport, page_size: int = 50, max_pages: int = 20, items: str = "items", cached: DataFrame | None = None) -> DataFrame:
    """The raw response of every page of every row of resources (resource, url), as RESPONSE.

    Each task asks for the pages of its resources one after the other, until one has fewer than page_size items, fails or
    isn't a JSON object, or max_pages are read: then `more` is true in the last row, as the resource may go on. `cached` (cache_key, body) holds responses of earlier runs, which aren't
    asked for again: they come with the resource's row, so a task holds those of one resource. Nothing is raised for a bad
    response: it is a row with its error. Write the result before using it twice, or the transport is called twice.
    """
    asked = resources.select("resource", "url").distinct()
    if cached is None:
        asked = asked.withColumn("known", F.lit(None).cast("map<string,string>"))
    else:
        pages = asked.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))))
        query = F.concat("url", F.lit("?offset="), (F.col("page") * page_size).cast("string"), F.lit(f"&limit={page_size}"))
        keyed = pages.withColumn("cache_key", F.substring(F.sha2(query, 256), 1, 20)).join(cached.select("cache_key", "body").dropDuplicates(["cache_key"]), "cache_key")
        known = keyed.groupBy("resource", "url").agg(F.map_from_entries(F.collect_list(F.struct("cache_key", "body"))).alias("known"))
        asked = asked.join(known, ["resource", "url"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RESPONSE.split(", ")]
        for pdf in batches:
            for resource, root, known in pdf[["resource", "url", "known"]].itertuples(index=False):
                known = dict(known or [])
                for page in range(max_pages):
                    url = f"{root}?{urlencode({'offset': page * page_size, 'limit': page_size})}"
                    key = cache_key(url)
                    status, body, error = (304, known[key], None) if key in known else transport(url)
                    count = -1
                    if error is None and body:
                        try:
                            found = json.loads(body)
                            count = len(found.get(items) or []) if isinstance(found, dict) else -1
                        except ValueError:
                            pass
                        error = None if count >= 0 else "no JSON object"
                    elif error is None:
                        error = "empty response"
                    sha = hashlib.sha256(body.encode()).hexdigest() if body else None
                    more = count >= page_size and page == max_pages - 1
                    yield pd.DataFrame([(resource, page, url, key, status, error, sha, body, more)], columns=columns)
                    if count < page_size:
                        break

    return asked.mapInPandas(run, RESPONSE)


def items_of(responses: DataFrame, schema: str, items: str = "items") -> DataFrame:
    """resource, page and the fields of `schema` of each item of the good responses."""
    parsed = responses.where("error is null").select("resource", "page", F.explode(F.from_json("body", f"{items} array<struct<{schema}>>")[items]).alias("item"))
    return parsed.select("resource", "page", "item.*")


def account(responses: DataFrame, day: str, budget: int) -> DataFrame:
    """resource, day, requests (cached ones don't count), errors and what is left of the day's budget, never below zero."""
    used = responses.groupBy("resource").agg(F.count_if(F.col("status") != 304).alias("requests"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return used.select("resource", F.lit(day).alias("day"), "requests", "errors", F.greatest(F.lit(0), F.lit(budget) - F.col("requests")).alias("left"))
