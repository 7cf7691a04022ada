"""Prompts for title and description fixes, and the parsing of what a model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.functions import text as t


def parse_responses(df: DataFrame, raw: str) -> DataFrame:
    """`df` with title and description (where the answer's are strings) and is_object, fences aside."""
    bare = F.regexp_replace(F.col(raw), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    parsed = F.try_parse_json(bare)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    text = lambda key: F.when(
        is_object & (F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")) == "STRING"),
        F.try_variant_get(parsed, f"$.{key}", "string"),
    )
    return df.withColumns({"title": text("title"), "description": text("description"), "is_object": is_object})


def prompts(pages: DataFrame) -> DataFrame:
    """url and prompt of pages (url, language, title, description, headings, excerpt, needs_title, needs_description).

    Names of fields come first on a line; personal data is taken out of what
    the page says; the answer is to be one JSON object with the wanted fields.
    """
    said = lambda name, value: F.concat(F.lit(f"{name} = "), t.redact(F.coalesce(value, F.lit("none"))))
    wanted = F.array_join(F.filter(F.array(F.when(F.col("needs_title"), "title"), F.when(F.col("needs_description"), "description")), lambda x: x.isNotNull()), ", ")
    lines = [
        F.concat(F.lit("page = "), "url"),
        F.concat(F.lit("answer in = "), "language"),
        said("title now", F.col("title")),
        said("description now", F.col("description")),
        said("headings", F.col("headings")),
        said("text begins", F.col("excerpt")),
        F.concat(F.lit("write a new = "), wanted),
    ]
    return pages.select("url", F.concat_ws("\n", *lines).alias("prompt"))
