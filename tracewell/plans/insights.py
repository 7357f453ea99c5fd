"""Insight cards from one row of facts about a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.constants import CARDS, NOTES, SHIFTS, WEEKDAYS

# Card ids and titles by tier; the highest threshold that is met wins.
ENGAGER_TIERS = ((25, "Engagement Machine"), (10, "Community Builder"), (3, "Super Engager"))
STREAK_TIERS = ((100, "Unstoppable Streak"), (30, "Streak Master"), (7, "Consistency Streak"))
QUIET_BELOW = 12


def _tier(value: Column, tiers) -> Column:
    out = F.lit(None).cast("string")
    for least, title in reversed(tiers):
        out = F.when(value >= least, F.lit(title)).otherwise(out)
    return out


def insights(facts: DataFrame) -> DataFrame:
    """Ordered cards (position, id, title, value) of facts: total, posts, comments, peak_hour, peak_day, trend_direction,
    trend_percent, shift_from, shift_to, ratio_direction, top_topic, top_count, current_streak. No cards without activity."""
    ratio = F.coalesce(F.try_divide(F.col("comments"), F.col("posts")), F.lit(0.0))
    card = lambda id_, title, value, when: F.when(when, F.struct(id_.alias("id"), title.alias("title"), value.cast("string").alias("value")))
    hour = F.col("peak_hour")
    by_hour = lambda a, b, c: F.when(hour <= 5, a).when(hour >= 21, b).otherwise(c)
    up = F.col("trend_direction") == "up"
    cards = F.array(
        card(by_hour("early-bird", "night-owl", "steady-pace"), by_hour("Early Bird", "Night Owl", "Steady Rhythm"), F.format_string("%02d:00", hour), F.lit(True)),
        card(F.when(up, "trending-up").otherwise("slowing"), F.when(up, "Trending Up").otherwise("Taking a Breather"), F.abs(F.floor(F.col("trend_percent") + 0.5)).cast("long"), F.col("trend_direction").isin("up", "down")),
        card(F.lit("topic-shift"), F.lit("Focus Shift"), F.concat_ws(" to ", "shift_from", "shift_to"), F.col("shift_from").isNotNull()),
        card(F.lit("engagement-shift"), F.lit("Engagement Style Shift"), F.col("ratio_direction"), F.col("ratio_direction").isNotNull()),
        card(F.lit("quiet-stretch"), F.lit("Quiet Stretch"), F.col("total"), F.col("total") < QUIET_BELOW),
        card(F.lit("super-engager"), _tier(ratio, ENGAGER_TIERS), F.format_string("%.1f", ratio), ratio >= ENGAGER_TIERS[-1][0]),
        card(F.lit("topic-master"), F.lit("Topic Focus"), F.concat_ws(" ", "top_topic", F.col("top_count").cast("string")), F.col("top_topic").isNotNull()),
        card(F.lit("streak"), _tier(F.col("current_streak"), STREAK_TIERS), F.col("current_streak"), F.col("current_streak") >= STREAK_TIERS[-1][0]),
        card(F.lit("weekday"), F.lit("Peak Day"), F.get(F.array(*map(F.lit, WEEKDAYS)), F.col("peak_day")), F.lit(True)),
    )
    rows = facts.where("total > 0").select(F.posexplode(F.filter(cards, lambda c: c.isNotNull())).alias("position", "card"))
    return rows.select(F.col("position").cast("long").alias("position"), "card.id", "card.title", "card.value")


def with_texts(cards: DataFrame) -> DataFrame:
    """Cards (id, title, value, ...) with body, icon and accent."""
    of = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    value = F.when(F.col("id") == "engagement-shift", of(SHIFTS, F.col("value"))).when(F.col("id") == "topic-master", F.regexp_replace("value", r" (\d+)\z", " shows up $1")).otherwise(F.col("value"))
    body = F.lit(None).cast("string")
    for name, (_, _, text) in CARDS.items():
        body = F.when(F.col("id") == name, F.format_string(text, value) if "%s" in text else F.lit(text)).otherwise(body)
    note = F.when(F.col("id") == "super-engager", of(NOTES, F.col("title"))).otherwise("")
    icon, accent = (of({k: v[i] for k, v in CARDS.items()}, F.col("id")) for i in (0, 1))
    return cards.select("*", F.concat(body, note).alias("body"), icon.alias("icon"), accent.alias("accent"))
