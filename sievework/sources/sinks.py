"""Sinks: bounded notifications, digests, calendars, cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_calendar, escape_markup


def bounded_queue(events: DataFrame, user: str, ts: str, tie: str, size: int) -> DataFrame:
    """Newest `size` events of each user: the oldest are dropped on overflow."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie)))
    return events.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r")


def event_stream(events: DataFrame, event: str, data: str) -> DataFrame:
    return events.select(F.format_string("event: %s\ndata: %s\n\n", F.col(event), F.col(data)).alias("value"))


def of_last_hours(df: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Rows of the trailing window, its start included, for a daily digest."""
    return df.where(F.col(ts) >= now - F.make_interval(hours=F.lit(hours)))


def digest(matches: DataFrame, user: str, title: str, url: str, order: list[str]) -> DataFrame:
    """One text and one HTML body for each user, items in order."""
    item = F.struct(*order, F.col(title).alias("_t"), F.col(url).alias("_u"))
    items = F.sort_array(F.collect_list(item))
    text = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["_t"], F.lit(" "), x["_u"])), "\n")
    html = F.transform(items, lambda x: F.concat(F.lit('<li><a href="'), escape_markup(x["_u"]), F.lit('">'), escape_markup(x["_t"]), F.lit("</a></li>")))
    return matches.groupBy(user).agg(F.count(F.lit(1)).alias("n"), text.alias("text"), F.concat(F.lit("<ul>"), F.array_join(html, ""), F.lit("</ul>")).alias("html"))


def calendar(entries: DataFrame, uid: str, start: str, summary: str) -> DataFrame:
    """iCalendar event blocks."""
    day = F.date_format(start, "yyyyMMdd")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid)), F.concat(F.lit("DTSTART;VALUE=DATE:"), day), F.concat(F.lit("SUMMARY:"), escape_calendar(F.col(summary))), F.lit("END:VEVENT")]
    return entries.select(F.concat_ws("\r\n", *lines).alias("value"))


def application_events(matches: DataFrame, key: str, created: str, place: str, title: str, url: str, apply_text: str, follow_text: str, check_text: str) -> DataFrame:
    """Two calendar events for each match: apply two days after it was made, follow up
    after fourteen. Texts are parameters."""
    days = lambda n: F.col(created) + F.make_interval(days=F.lit(n))
    job = F.concat(F.lit("Job: "), F.col(title))
    both = [("apply", apply_text, 2, job), ("followup", follow_text, 14, F.concat(F.lit(check_text), F.lit(" "), job))]
    events = F.array(
        *[F.struct(F.concat(F.lit(f"{kind}-"), F.col(key)).alias("uid"), F.concat(F.lit(text), F.lit(" — "), F.col(place)).alias("summary"), days(n).alias("start"), about.alias("description")) for kind, text, n, about in both]
    )
    return matches.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("url"), F.explode(events).alias("e")).select(key, "e.*", "url")


def calendar_files(events: DataFrame, group: str, now: Column, producer: str, domain: str, minutes: int = 30) -> DataFrame:
    """(group, value): one iCalendar file for each group, events by start and uid.
    events(group, uid, summary, start, description, url), moments in UTC."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid"), F.lit(f"@{domain}")), F.concat(F.lit("DTSTAMP:"), stamp(now)), F.concat(F.lit("DTSTART:"), stamp(F.col("start"))),
        F.concat(F.lit("DTEND:"), stamp(F.col("start") + F.make_interval(mins=F.lit(minutes)))), F.concat(F.lit("SUMMARY:"), escape_calendar(F.col("summary"))),
        F.concat(F.lit("DESCRIPTION:"), escape_calendar(F.col("description"))), F.concat(F.lit("URL:"), escape_calendar(F.col("url"))), F.lit("END:VEVENT"),
    ]
    item = F.struct("start", "uid", F.concat_ws("\r\n", *lines).alias("text"))
    head = "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{producer}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", ""])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), "\r\n")
    return events.groupBy(group).agg(F.concat(F.lit(head), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("value"))


def alert_mails(jobs: DataFrame, user: str, intro: str, one: str, many: str, order: list[str]) -> DataFrame:
    """(user, n, subject, text, html) of new postings(title, company, canton, location,
    url): `one` or `many` is the subject, {n} being their number; markup is escaped."""
    dash = F.lit("—")
    filled_or = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], dash)
    title, url = F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.concat(F.lit("- "), title, F.lit(" · "), filled_or("company"), F.lit(" · "), filled_or("canton", "location"), F.lit("\n  "), url)
    e = escape_markup
    html = F.concat(
        F.lit("<li><strong>"), e(title), F.lit("</strong> — "), e(filled_or("company")), F.lit(" ("), e(filled_or("canton", "location")), F.lit(')<br><a href="'), e(url), F.lit('">'), e(url), F.lit("</a></li>")
    )
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("_text"), html.alias("_html"))))
    joined = lambda c, by: F.array_join(F.transform(rows, lambda x: x[c]), by)
    n = F.count(F.lit(1))
    subject = F.when(n == 1, F.lit(one)).otherwise(F.replace(F.lit(many), F.lit("{n}"), n.cast("string")))
    return jobs.groupBy(user).agg(
        n.alias("n"), subject.alias("subject"), F.concat(F.lit(f"{intro}\n\n"), joined("_text", "\n")).alias("text"), F.concat(F.lit(f"<p>{intro}</p><ul>"), joined("_html", ""), F.lit("</ul>")).alias("html")
    )


def cached(requests: DataFrame, cache: DataFrame, key: Column, now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(answered requests, those to ask): cache(key, value, stored_at), md5 keys, entries expire."""
    r = requests.withColumn("_key", F.md5(key))
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= ttl_seconds).select(F.col("key").alias("_key"), "value")
    return r.join(live, "_key"), r.join(live, "_key", "left_anti").drop("_key")
