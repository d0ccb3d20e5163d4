"""Labels for people: deadlines, tags, eligibility, contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.money import short_money
from tabulon.functions.text import safe_email

#: Deadline kinds and their labels.
KIND_LABELS = {
    "letter_of_intent": "Letter of intent",
    "concept_paper": "Concept paper",
    "preproposal": "Preproposal",
    "question": "Questions",
    "application": "Application",
    "estimated_application": "Estimated application",
}


def date_label(d: Column) -> Column:
    return F.date_format(d, "MMM d, yyyy")


def deadline_label(close: Column, rolling: Column, estimated: Column) -> Column:
    """Rolling, rolling through a day, estimated, a day, or not listed."""
    day, open_ended = date_label(close), F.coalesce(rolling, F.lit(False))
    return (
        F.when(open_ended & close.isNull(), "Rolling")
        .when(open_ended, F.concat(F.lit("Rolling through "), day))
        .when(F.coalesce(estimated, F.lit(False)) & close.isNotNull(), F.concat(F.lit("Estimated "), day))
        .otherwise(F.coalesce(day, F.lit("Not listed")))
    )


def kind_label(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.coalesce(kind, F.lit(""))), F.lit("Deadline"))


def days_until(d: Column, today: Column) -> Column:
    return F.datediff(d, today)


def card_tags(disciplines: Column, topics: Column, most: int = 3) -> Column:
    """The first two of either, at most three."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.slice(F.coalesce(disciplines, none), 1, 2), F.slice(F.coalesce(topics, none), 1, 2))), 1, most)


def some_of(values: Column, shown: int = 2, empty: str = "Not listed") -> Column:
    """The first values and how many more there are."""
    n = F.size(values)
    more = F.when(n > shown, F.concat(F.lit(" +"), (n - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(empty)).otherwise(F.concat(F.array_join(F.slice(values, 1, shown), ", "), more))


def contact_link(email: Column, phone: Column) -> Column:
    """mailto: of a valid address, else tel: of the digits, else null."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9+]", "")
    return F.coalesce(F.concat(F.lit("mailto:"), safe_email(email)), F.when(F.length(digits) >= 7, F.concat(F.lit("tel:"), digits)))


def total_label(total: Column) -> Column:
    return F.coalesce(short_money(total), F.lit("Not listed"))


def search_label(query: Column, filters: Column) -> Column:
    """A saved search in words: its text and its filters (array<struct<facet, values>>)."""
    parts = F.transform(filters, lambda f: F.concat(f["facet"], F.lit(": "), F.array_join(f["values"], ", ")))
    text = F.when(F.trim(F.coalesce(query, F.lit(""))) != "", F.concat(F.lit("“"), F.trim(query), F.lit("”")))
    return F.coalesce(F.nullif(F.array_join(F.filter(F.concat(F.array(text), parts), lambda p: p.isNotNull()), "; "), F.lit("")), F.lit("All records"))
