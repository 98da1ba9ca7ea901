"""Tokenizers, frontmatter and text-shaping expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns. Identifiers such as e-121 or art-3.1 stay whole.
HYPHEN_TOKENS = "[a-z0-9]+(?:-[a-z0-9]+)*"
DOTTED_TOKENS = "[a-z0-9]+(?:[-.][a-z0-9]+)*"
WORD_TOKENS = r"(?U)\w+"

# Fixed value: the frontmatter block.
FRONTMATTER = r"(?s)^---[^\S\n]*\n(.*?)\n---[^\S\n]*\n"

# Display labels of the source types.
SOURCE_LABELS = {
    "manual": "CONTROLLED MANUAL",
    "technical_doc": "TECHNICAL DOCUMENT",
    "expert_note": "EXPERT FIELD NOTE (experience from one site)",
}


def tokens(text: Column, pattern: str = HYPHEN_TOKENS) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))



def first_integer(text: Column) -> Column:
    """First run of digits as a number, null when there is none."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("double")


def frontmatter(text: Column) -> Column:
    """Map of the ``key: value`` lines of the leading block; empty when there is none."""
    block = F.regexp_extract(text, FRONTMATTER, 1)
    lines = F.filter(F.split(block, "\n"), lambda line: line.rlike(r"^\s*[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(
        lines,
        lambda line: F.struct(
            F.trim(F.regexp_extract(line, r"^\s*([A-Za-z_][\w-]*)\s*:", 1)).alias("key"),
            F.regexp_replace(
                F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)), "^([\"'])(.*)\\1$", "$2"
            ).alias("value"),
        ),
    )
    return F.map_from_entries(entries)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def meta(fields: Column, key: str, default: Column | str) -> Column:
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.element_at(fields, F.lit(key)), fallback)


def source_label(source_type: Column, labels: Mapping[str, str] = SOURCE_LABELS) -> Column:
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), source_type), F.upper(source_type))


def citation(title: Column, section: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(title, F.lit(" > "), section)).otherwise(title)


def with_context(title: Column, section: Column, piece: Column) -> Column:
    """Prefix a piece with its title and heading trail, so that short pieces stay findable."""
    head = F.when(section != "", F.concat(title, F.lit("\n"), section)).otherwise(title)
    return F.concat(head, F.lit("\n\n"), piece)


def sorted_list(text: Column) -> Column:
    """Comma list to a sorted array of distinct, non-empty entries."""
    parts = F.filter(F.split(text, ","), lambda part: part != "")
    return F.array_sort(F.array_distinct(parts))
