"""Message and connection exports, from files to panels and threads."""

from tracewell.functions.constants import ANONYMOUS
from tracewell.plans import export
from tracewell.plans import relationships as R

MESSAGES = f"""CONVERSATION ID,FROM,TO,DATE,CONTENT,FOLDER,SENDER PROFILE URL,RECIPIENT PROFILE URLS
c1,Me,Ada L,2026-01-05 10:00:00 UTC,hello,INBOX,https://x/me,https://x/ada/
c1,Ada L,Me,2026-01-06 10:00:00 UTC,hi,INBOX,https://x/ADA,https://x/me
c2,Bob,Me,2026-06-01 09:00:00 UTC,old friend,INBOX,,https://x/me
c3,Me,{ANONYMOUS.title()},2026-06-02 09:00:00 UTC,who,INBOX,https://x/me,
c4,Me,Ada L,not a date,x,INBOX,https://x/me,
"""
CONNECTIONS = """Notes:
x

First Name,Last Name,URL,Email Address,Company,Position,Connected On
Ada,L,https://x/ada,,Engines,Analyst,05 Jan 2025
Bob,,,,Shop,,06 Feb 2025
Cy,D,https://x/cy,,Mill,Miller,
Di,E,https://x/di,,Mill,Miller,07 Mar 2025
"""


def loaded(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSAGES)
    (tmp_path / "c.csv").write_text(CONNECTIONS)
    return R.messages_of(export.cleaned(spark, str(tmp_path / "m.csv"))), R.connections_of(export.cleaned(spark, str(tmp_path / "c.csv")))


def test_panels(spark, tmp_path):
    messages, connections = loaded(spark, tmp_path)
    assert messages.count() == 4 and connections.count() == 3  # one row has no date to show, one none to clean
    got = {k: [tuple(r) for r in df.collect()] for k, df in R.panels(messages, connections, "2026-06-10").items()}
    assert [(r[0], r[1], r[2]) for r in got["top"]] == [("Ada L", "https://x/ada", 2), ("Bob", "", 1)]
    assert [r[0] for r in got["silent"]] == ["Di E"]
    assert [(r[0], r[2], r[4]) for r in got["fading"]] == [("Ada L", 154, "Engines")]


def test_threads_of_files(spark, tmp_path):
    messages, connections = loaded(spark, tmp_path)
    got = {}
    for r in R.recent(messages, connections).orderBy("seq").collect():
        got.setdefault(r["name"], []).append((r.direction, r.body))
    assert got["Ada L"] == [("sent", "hello"), ("received", "hi")] and got["Bob"] == [("received", "old friend")] and len(got) == 3
    assert {r.contact_key for r in R.contact_keys(connections).collect()} == {"ada l", "bob", "di e", "https://x/ada", "https://x/di"}
