"""Every insight card has its text, icon and accent."""

from tracewell.functions.constants import CARDS
from tracewell.plans.insights import with_texts


def test_texts(spark):
    cards = [("early-bird", "Early Bird", "05:00"), ("slowing", "Taking a Breather", "13"), ("topic-shift", "Focus Shift", "a b to c"), ("engagement-shift", "Engagement Style Shift", "more-posting"), ("super-engager", "Community Builder", "12.5"), ("topic-master", "Topic Focus", "big data 17"), ("streak", "Streak Master", "31"), ("quiet-stretch", "Quiet Stretch", "3"), ("weekday", "Peak Day", "Friday")]
    got = {r.id: (r.body, r.icon, r.accent) for r in with_texts(spark.createDataFrame(cards, "id string, title string, value string")).collect()}
    assert got["early-bird"][0] == "Your peak hour is 05:00. Mornings are your power time." and got["slowing"][0] == "Activity is down 13% compared to the previous period."
    assert got["topic-shift"][0] == "Your focus shifted from a b to c." and got["engagement-shift"][0].startswith("You are posting more")
    assert got["super-engager"][0] == "You comment 12.5x more than you post. You invest heavily in other people's posts."
    assert got["topic-master"][0] == "big data shows up 17 times in your recent activity." and got["streak"][0] == "You have a 31-day activity streak going."
    assert all(got[k][1:] == CARDS[k][:2] for k in got) and got["weekday"][0] == "Friday is your strongest day for activity."
