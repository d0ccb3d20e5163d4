"""Competition cards of a portal, whose payloads are a list, a wrapper around one, or a single object.

Payloads are VARIANT values, so one expression reads all three forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import eastern_date
from tabulon.sources.exports import at, kind_of, strict_json

#: Names under which payloads carry the list, and cards their fields; the first that is there counts.
WRAPPERS = ("competitions", "Competitions", "cards", "results", "data", "items", "homepageItems")
FIELDS = {
    "title": ("title", "Title", "name"),
    "id": ("opportunityId", "cardId", "id"),
    "description": ("description", "Description", "summary"),
    "due": ("dueDate", "applicationDeadline", "deadline", "closeDate"),
}


def cards_in(payload: Column) -> Column:
    """array<variant> of the objects of a payload (VARIANT)."""
    wrapped = F.coalesce(*[F.when(kind_of(at(payload, f"$.{w}", "variant")) == "ARRAY", at(payload, f"$.{w}", "array<variant>")) for w in WRAPPERS])
    kind = kind_of(payload)
    found = F.when(kind == "ARRAY", at(payload, "$", "array<variant>")).when(kind == "OBJECT", F.coalesce(wrapped, F.array(payload)))
    return F.filter(found, lambda x: kind_of(x) == "OBJECT")


def first_of(card: Column, field: str) -> Column:
    """The first value that is there and not ''."""
    return F.coalesce(*[F.nullif(at(card, f"$.{name}"), F.lit("")) for name in FIELDS[field]])


def _is_zero(card: Column) -> Column:
    """Whether the id is the number 0, which counts as none; the text "0" is an id."""
    there = [F.when(F.nullif(at(card, f"$.{n}"), F.lit("")).isNotNull(), (kind_of(at(card, f"$.{n}", "variant")) != "STRING") & (at(card, f"$.{n}", "double") == 0)) for n in FIELDS["id"]]
    return F.coalesce(*there, F.lit(False))


def due_date(text: Column) -> Column:
    """ISO date in New York of a UTC stamp ``MM/DD/YYYY HH:MM:SS``; of other texts the first word."""
    return F.coalesce(F.date_format(eastern_date(text), "yyyy-MM-dd"), F.nullif(F.regexp_extract(text, r"\S+", 0), F.lit("")))


def competitions(payloads: DataFrame, key: str, text: str, listing_url: str) -> DataFrame:
    """(key, external_id, title, url, description, close_date) of all cards with a title."""
    each = payloads.select(key, F.explode(cards_in(strict_json(F.col(text)))).alias("card"))
    card = F.col("card")
    number = F.when(~_is_zero(card), first_of(card, "id"))
    url = F.when(number.isNotNull(), F.concat(F.lit(f"{listing_url}#competitionDetail/"), number)).otherwise(F.lit(listing_url))
    title = first_of(card, "title")
    out = each.select(key, F.coalesce(number, title).alias("external_id"), title.alias("title"), url.alias("url"), first_of(card, "description").alias("description"), due_date(first_of(card, "due")).alias("close_date"))
    return out.where("title is not null")
