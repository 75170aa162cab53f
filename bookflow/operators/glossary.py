"""Glossary: merging rules, the ordered replacement pass over texts, and the prompt that states the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.functions.text import py_strip

#: Rules are configuration: more than this is refused, since each is an expression of the plan.
MOST_RULES = 2_000
NAMED = r"[\p{L}\p{N}_]"


@dataclass(frozen=True)
class Rule:
    source: str
    target: str


def rules_in_order(rules: DataFrame) -> list[Rule]:
    """The rules by id: the order in which they are applied."""
    rows = rules.where("source_term is not null and source_term <> '' and target_term is not null").select("id", "source_term", "target_term").orderBy("id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} glossary rules")
    return [Rule(r["source_term"], r["target_term"]) for r in rows]


def _quoted(term: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in term)


def replaced(text: Column, rules: list[Rule]) -> Column:
    """Each rule in turn, on what the rules before left; whole words only where the term is one word; the target is literal."""
    for r in rules:
        word = all(c.isalnum() or c == "_" for c in r.source)
        pattern = f"(?iu)(?<!{NAMED}){_quoted(r.source)}(?!{NAMED})" if word else f"(?iu){_quoted(r.source)}"
        text = F.regexp_replace(text, pattern, r.target.replace("\\", "\\\\").replace("$", "\\$"))
    return text


PROMPT = "You translate chapters of serial fiction into Arabic. Keep names and terms as the glossary has them."


def prompt(rules: DataFrame) -> DataFrame:
    """One row: the instruction with the rules, one on a line, by id."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "source_term", "target_term"))), lambda r: F.concat(F.lit('- "'), r["source_term"], F.lit('" → "'), r["target_term"], F.lit('"'))), "\n")
    return rules.agg(F.when(F.count("*") > MOST_RULES, F.raise_error(F.lit(f"more than {MOST_RULES} glossary rules"))).when(F.count("*") > 0, F.concat(F.lit(PROMPT + "\n\nGlossary:\n"), lines)).otherwise(F.lit(PROMPT)).alias("prompt"))


def key(term: Column) -> Column:
    return F.lower(py_strip(term))


def merged(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """(term, target_term, origin): existing rules and the incoming ones by their folded terms.

    Without ``overwrite`` existing rules stay and the first of incoming duplicates counts; with it the last incoming counts."""
    keyed = incoming.withColumn("term", key(F.col("source_term"))).withColumn("target", py_strip(F.col("target_term"))).where("term <> '' and target <> ''")
    w = Window.partitionBy("term").orderBy(F.desc("id") if overwrite else F.asc("id"))
    new = keyed.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("term", F.col("target").alias("new_target"))
    old = existing.withColumn("term", key(F.col("source_term"))).groupBy("term").agg(F.min_by("target_term", "id").alias("old_target"))
    both = old.join(new, "term", "full_outer")
    target = F.coalesce("new_target", "old_target") if overwrite else F.coalesce("old_target", "new_target")
    origin = F.when(F.col("old_target").isNull(), "inserted").when(F.col("new_target").isNotNull() & F.lit(overwrite), "updated").otherwise("kept")
    return both.select("term", target.alias("target_term"), origin.alias("origin"))
