"""Sinks: CSV, calendars, Atom feeds, wrapped JSON and digests, each assembled from rows by expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import csv_cell, escape_html, ics_escape, truncate

#: Fixed value: characters of a description in a digest.
DIGEST_CHARS = 240
BOM = "﻿"


def csv_lines(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, line): one quoted CSV line a row; lists are joined by '; '."""
    cells = [csv_cell(F.concat_ws("; ", c) if records.schema[c].dataType.typeName() == "array" else F.col(c)) for c in columns]
    return records.select(key, F.concat_ws(",", *cells).alias("line"))


def write_csv(records: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Quoted CSV with a header and no line breaks inside cells."""
    cells = [F.regexp_replace(F.concat_ws("; ", c) if records.schema[c].dataType.typeName() == "array" else F.col(c).cast("string"), r"\r\n|\r|\n", " ").alias(c) for c in columns]
    records.select(*cells).write.csv(path, header=True, quoteAll=True, escape='"')


def calendar_events(records: DataFrame, as_of: Column) -> DataFrame:
    """(opportunity_id, title, kind, date): future deadlines; without any the closing date."""
    close = F.when(F.col("close_date").isNotNull(), F.array(F.struct(F.lit("application").alias("kind"), F.col("close_date").cast("date").alias("date"))))
    listed = F.transform(F.coalesce("deadlines", F.array().cast(records.schema["deadlines"].dataType)), lambda d: F.struct(d["kind"].alias("kind"), d["date"].alias("date")))
    ahead = F.filter(listed, lambda d: d["date"] >= as_of)
    chosen = F.when(F.size(ahead) > 0, ahead).otherwise(F.filter(close, lambda d: d["date"] >= as_of))
    return records.select("opportunity_id", "title", F.explode(chosen).alias("d")).select("opportunity_id", "title", "d.kind", "d.date")


def ics(events: DataFrame) -> DataFrame:
    """(opportunity_id, date, event): one all-day VEVENT a row."""
    day = F.date_format("date", "yyyyMMdd")
    lines = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), ics_escape("opportunity_id"), F.lit("-"), F.col("kind"), F.lit("-"), day),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), day),
        F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add("date", 1), "yyyyMMdd")),
        F.concat(F.lit("SUMMARY:"), ics_escape("title")),
        F.lit("END:VEVENT"),
    )
    return events.select("opportunity_id", "date", lines.alias("event"))


def atom_entry(title: Column, url: Column, key: Column, updated: Column, summary: Column, categories: Column) -> Column:
    """One Atom entry with at most eight categories."""
    cats = F.array_join(F.transform(F.slice(categories, 1, 8), lambda c: F.concat(F.lit('<category term="'), escape_html(c), F.lit('"/>'))), "")
    return F.concat(
        F.lit("<entry><id>urn:record:"), F.url_encode(key), F.lit("</id><title>"), escape_html(title), F.lit('</title><link href="'), escape_html(url),
        F.lit('"/><updated>'), F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>"), escape_html(summary), F.lit("</summary>"), cats, F.lit("</entry>"),
    )


def atom_feeds(entries: DataFrame, title: Column) -> DataFrame:
    """(feed, n, updated, document) from (feed, position, updated, entry); feeds hold a bounded number of entries."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda e: e["entry"]), "")
    made = entries.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.max("updated").alias("updated"), body.alias("_body"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>'), escape_html(title), F.lit("</title><updated>"), F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated>"))
    return made.select("feed", "n", "updated", F.concat(head, "_body", F.lit("</feed>")).alias("document"))


def summary_line(agency: Column, close: Column, status: Column, description: Column) -> Column:
    """agency — Closes date (or status) — start of the description."""
    when = F.coalesce(F.concat(F.lit("Closes "), F.date_format(close, "yyyy-MM-dd")), status)
    return F.concat_ws(" — ", F.nullif(agency, F.lit("")), when, F.nullif(truncate(description, 400), F.lit("")))


def digest_text(items: DataFrame, subscription: str) -> DataFrame:
    """(subscription, n, body): a plain-text digest of a bounded list (position, title, url)."""
    line = F.concat(F.col("position").cast("string"), F.lit(". "), F.col("title"), F.lit("\n   "), F.coalesce("url", F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n")
    return items.groupBy(subscription).agg(F.count(F.lit(1)).alias("n"), body.alias("body"))


def digest_html(items: DataFrame, subscription: str) -> DataFrame:
    """(subscription, n_new, n_changed, body): an HTML digest of bounded lists.

    ``items``: kind (``new``, or that of a change), position, title, url, label,
    detail (a description's first characters, or what has changed), and meta
    (array of texts); everything is escaped here.
    """
    title = escape_html(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled opportunity")))
    link = F.concat(F.lit('<a href="'), escape_html(F.coalesce("url", F.lit(""))), F.lit('">'), title, F.lit("</a>"))
    meta = escape_html(F.array_join(F.filter("meta", lambda m: F.coalesce(m != "", F.lit(False))), " · "))
    detail = escape_html(F.substring(F.coalesce("detail", F.lit("")), 1, DIGEST_CHARS))
    label = escape_html(F.coalesce(F.nullif("label", F.lit("")), F.lit("Opportunity update")))
    is_new = F.col("kind") == "new"
    line = F.when(is_new, F.concat(F.lit("<li>"), link, F.lit("<br>"), meta, F.lit("<br>"), detail, F.lit("</li>"))).otherwise(F.concat(F.lit("<li><strong>"), label, F.lit(":</strong> "), link, F.lit("<br>"), detail, F.lit("</li>")))

    def lines(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("position", line.alias("line"))))), lambda x: x["line"]), "")

    got = items.groupBy(subscription).agg(F.count_if(is_new).alias("n_new"), F.count_if(~is_new).alias("n_changed"), lines(is_new).alias("_new"), lines(~is_new).alias("_changed"))

    def part(name: str, rows: str) -> Column:
        return F.when(F.col(rows) != "", F.concat(F.lit(f"<h3>{name}</h3><ul>"), F.col(rows), F.lit("</ul>"))).otherwise("")

    body = F.concat(F.lit("<!doctype html><html><body>"), part("New matches", "_new"), part("Changes to matches you follow", "_changed"), F.lit("</body></html>"))
    return got.select(subscription, "n_new", "n_changed", body.alias("body"))


def wrapped_json(rows: DataFrame, name: str) -> Column:
    """Script text that assigns a JSON object, safe inside a page."""
    return F.concat(F.lit(f"globalThis.{name}="), F.replace(F.to_json(F.struct(*[F.col(c) for c in rows.columns])), F.lit("</"), F.lit("<\\/")), F.lit(";"))
