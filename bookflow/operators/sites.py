"""Site definitions: which site an address belongs to, and what its definition says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions import urls

#: Site definitions are configuration; more than this is refused, since each is a branch of an expression.
MOST_SITES = 1_000


def registry(sites: DataFrame, more: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(site, the tokens of which its addresses contain one), by priority: its host, what the column ``tokens`` holds (if the table has it), and ``more`` by site."""
    own = F.col("tokens") if "tokens" in sites.columns else F.array().cast("array<string>")
    rows = sites.where("site_id is not null").select("priority", "site_id", urls.host(F.col("base_url")).alias("host"), own.alias("tokens")).orderBy("priority", "site_id").limit(MOST_SITES + 1).collect()
    if len(rows) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites")
    each = [(r["site_id"], [t for t in (r["host"], *(r["tokens"] or ()), *(more or {}).get(r["site_id"], ())) if t]) for r in rows]
    return [(site, tokens) for site, tokens in each if tokens]


def resolved(url: Column, found: list[tuple[str, list[str]]]) -> Column:
    """The first site of whose tokens the address contains one, null without any."""
    out = F.lit(None).cast("string")
    for site, tokens in reversed(found):
        hit = F.contains(url, F.lit(tokens[0]))
        for t in tokens[1:]:
            hit = hit | F.contains(url, F.lit(t))
        out = F.when(hit, site).otherwise(out)
    return out


def definition(url: Column, priority: Column) -> Column:
    """A site definition made from an address: its key, base, and settings to start from."""
    host = urls.host(url)
    return F.struct(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), "[^a-z0-9]+", "_").alias("site_id"), F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1).alias("base_url"), priority.alias("priority"), F.lit(False).alias("is_native_arabic"))


def with_native_flag(novels: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds whether the book's site has texts that need no translation; false for unknown sites."""
    flags = sites.groupBy(F.col("site_id").alias("source_site")).agg(F.max("is_native_arabic").alias("native"))
    return novels.join(flags, "source_site", "left").withColumn("native", F.coalesce("native", F.lit(False)))


#: Parts of an address that suggest protection, or pages built by scripts (fixed values).
PROTECTED, SCRIPTED = "cloudflare|protected|wordpress|wp-", "app|javascript|dynamic|series"


def suggested_method(url: Column) -> Column:
    """How pages of an address are likely fetched: 1 protected, 2 rendered, 0 plain."""
    low = F.lower(url)
    return F.when(low.rlike(PROTECTED), 1).when(low.rlike(SCRIPTED), 2).otherwise(0)
