"""References inside JSON of any shape, and manifests of a fixed one."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions import text as X
from bookflow.functions.urls import CHAPTER, chapter_number

#: Keys under which an object may hold a chapter's address or a title, in order of preference (fixed values).
URL_KEYS = ("href", "url", "path", "link", "chapterUrl", "chapter_url", "slug")
TITLE_KEYS = ("title", "name", "chapterTitle", "chapter_title")
_CHAPTER = re.compile(CHAPTER)

MANIFEST = "struct<chapters:array<struct<url:string,label:string,title:string>>>"


def manifest(payload: Column) -> Column:
    """References of a manifest, in its order; an empty list for anything that is none."""
    parsed = F.from_json(payload, MANIFEST)["chapters"]
    return F.coalesce(F.transform(parsed, lambda c, i: F.struct(i.alias("pos"), c["url"].alias("url"), F.trim(F.concat_ws(" ", c["label"], c["title"])).alias("title"))), F.array().cast("array<struct<pos:int,url:string,title:string>>"))


def embedded(html: Column) -> Column:
    """The JSON that a page embeds as its data."""
    return F.nullif(F.regexp_extract(html, r"""(?s)<script[^>]*\bid\s*=\s*["']?__NEXT_DATA__["']?[^>]*>(.*?)</script>""", 1), F.lit(""))


def walked(payload: str | None) -> list[dict]:
    """Depth-first: every object with a chapter's address gives a candidate for its title; each address once, where it is first seen; invalid JSON gives none."""
    try:
        root = json.loads(payload or "")
    except ValueError:
        return []
    found: dict[str, list[str]] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            url = next((x[k] for k in URL_KEYS if isinstance(x.get(k), str) and _CHAPTER.search(x[k])), None)
            if url:
                title = next((x[k] for k in TITLE_KEYS if isinstance(x.get(k), str) and x[k].strip()), None)
                found.setdefault(url, []).extend([] if title is None else [title])
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return [{"pos": i, "url": u, "titles": t} for i, (u, t) in enumerate(found.items())]


def references(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, pos, url, title) of all references in JSON of any shape."""

    @F.pandas_udf("array<struct<pos:int,url:string,titles:array<string>>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(walked)

    found = df.select(key, F.explode(run(payload)).alias("x")).select(key, "x.*")
    return found.select(key, "pos", "url", X.best_title(F.col("titles"), chapter_number(F.col("url")), F.col("pos") + 1).alias("title"))
