"""Configuration sources: site definitions, glossary rules and settings files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.text import py_strip

_SITE = "struct<base_url:string,selectors:map<string,string>,request_delay_min:double,request_delay_max:double,use_curl_cffi:boolean,respect_robots_txt:boolean>"


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A file of the form {site: {definition}}, one row per site; read with a fixed schema."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{_SITE}>")).alias("site_id", "x")).select("site_id", "x.*")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A file of the form {"rules": [...]}, one row per rule, in the file's order."""
    text = spark.read.text(path, wholetext=True)
    rules = F.from_json("value", "struct<rules:array<struct<id:bigint,source_term:string,target_term:string,notes:string>>>")["rules"]
    return text.select(F.posexplode(rules).alias("pos", "x")).select("pos", "x.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a small file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def settings(lines: DataFrame) -> DataFrame:
    """(name, value) of settings lines: blank lines and comments skipped, split at the first "=", the last of a name counts."""
    plain = lines.withColumn("line", py_strip(F.col("line"))).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("=")))
    parts = F.split("line", "=", 2)
    return plain.select("line_no", py_strip(parts[0]).alias("name"), py_strip(parts[1]).alias("value")).groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


def classified_settings(named: DataFrame) -> DataFrame:
    """Each setting's kind and provider by its name's ending."""
    name = F.col("name")
    kind = F.when(F.endswith(name, F.lit("_API_KEY")), "API Key").when(F.endswith(name, F.lit("_MODEL")), "Model").when(F.endswith(name, F.lit("_BASE_URL")), "Base URL").otherwise("Custom")
    provider = F.initcap(F.replace(F.regexp_replace(name, "(_API_KEY|_BASE_URL|_MODEL)$", ""), F.lit("_"), F.lit(" ")))
    return named.select("name", kind.alias("kind"), provider.alias("provider"), name.rlike("^[A-Z][A-Z0-9_]*$").alias("valid"))


def patched(named: DataFrame, updates: DataFrame, removed: DataFrame) -> DataFrame:
    """(name, value, change): settings after updates and removals; new ones are added."""
    both = named.join(removed, "name", "left_anti").join(updates, "name", "full_outer")
    change = F.when(F.col("value").isNull(), "added").when(F.col("new_value").isNotNull(), "updated").otherwise("kept")
    return both.select("name", F.coalesce("new_value", "value").alias("value"), change.alias("change"))


def patched_lines(lines: DataFrame, updates: DataFrame, removed: DataFrame) -> DataFrame:
    """(line_no, line): a settings file after updates and removals, in its order: comments and blank lines stay, new settings come last, by name.

    A settings file is small; its lines meet in one row."""
    name = py_strip(F.split("line", "=", 2)[0])
    plain = py_strip(F.col("line"))
    named = lines.select("line_no", "line", F.when((plain != "") & ~F.startswith(plain, F.lit("#")) & F.contains(plain, F.lit("=")), name).alias("name"))
    kept = named.join(removed.select("name").distinct(), "name", "left_anti").join(updates.select("name", "new_value"), "name", "left")
    shown = kept.select(F.lit(0).alias("late"), "line_no", F.lit("").alias("by"), F.when(F.col("new_value").isNotNull(), F.concat("name", F.lit("="), "new_value")).otherwise(F.col("line")).alias("line"))
    new = updates.join(named.where("name is not null").select("name").distinct(), "name", "left_anti").join(removed.select("name").distinct(), "name", "left_anti")
    added = new.select(F.lit(1).alias("late"), F.lit(0).cast("long").alias("line_no"), F.col("name").alias("by"), F.concat("name", F.lit("="), "new_value").alias("line"))
    every = shown.withColumn("line_no", F.col("line_no").cast("long")).unionByName(added).agg(F.array_sort(F.collect_list(F.struct("late", "line_no", "by", "line"))).alias("x"))
    return every.select(F.posexplode("x").alias("line_no", "x")).select("line_no", "x.line")


def read_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """All definition files of a folder, by file name and site; where a site is defined twice, the last file counts. No code is run."""
    text = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    each = text.select("file", F.explode(F.from_json("value", f"map<string,{_SITE}>")).alias("site_id", "x"))
    return each.groupBy("site_id").agg(F.max_by("x", "file").alias("x")).select("site_id", "x.*").orderBy("site_id")
