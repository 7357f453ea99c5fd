"""The registered people_budget against a plain loop, on mailboxes with threads wider than the budget."""

import random
from datetime import datetime, timedelta

import pytest

from tracewell import queries


def expected(orders, budget=10):
    threads = {}
    for _, c, _, at in orders:
        last, members = threads.setdefault(f"{c // 12} {at.year}-{(at.month - 1) // 3 * 3 + 1:02}", [at, set()])
        members.add(c)
        threads[f"{c // 12} {at.year}-{(at.month - 1) // 3 * 3 + 1:02}"][0] = max(last, at)
    seen, taken = set(), {}
    for name, (_, members) in sorted(sorted(threads.items()), key=lambda t: t[1][0], reverse=True):
        if len(seen) < budget and len(seen | members) <= budget:
            seen |= members
            taken[name] = len(members)
    return taken, max(len(m) for _, m in threads.values())


@pytest.mark.parametrize("seed", range(4))
def test_query_is_the_plain_loop(spark, tmp_path, seed):
    rng = random.Random(seed)
    start = datetime(2000, 1, 1)
    orders = [(i, rng.randrange(12), rng.choice("FO"), start + timedelta(days=rng.randrange(91, 182))) for i in range(90)]  # one thread of twelve
    orders += [(90 + i, rng.randrange(48), rng.choice("FO"), start + timedelta(days=rng.randrange(91))) for i in range(30)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    taken, widest = expected(orders)
    got = {r.thread: r.members for r in queries.QUERIES["people_budget"](spark, str(tmp_path)).collect()}
    assert got == taken and widest > 10 and max(got.values()) > 4
