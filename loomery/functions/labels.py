"""Display helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category slugs with labels of their own.
CATEGORY_LABELS = {
    "content": "Content extraction",
    "ecommerce": "Ecommerce",
    "leads": "Lead generation",
    "search": "Search",
    "social": "Social",
}


def title_case(slug: Column) -> Column:
    """Parts between hyphens with a capital first letter, the rest of each part as it is."""
    parts = F.filter(F.split(slug, "-"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), " ")


def category_label(slug: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, slug), title_case(slug))


def clipped(text: Column, most: int = 48) -> Column:
    """A text of more than `most` characters ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)
