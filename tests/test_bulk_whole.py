import math
from collections import Counter

from kinmatch.plans import catalog, reports, views


def like(a, b, least):
    if a[1] != b[1]:
        return False
    x, y = (Counter(t[0].lower().split()) for t in (a, b))
    if not x or not y:
        return x == y
    return sum(x[w] * y[w] for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) >= least - 1e-12


def test_whole_table_and_queue_are_probed(spark, sf):
    rows = {r["row_no"]: (r["text"], r["numeric"]) for r in views.items(spark, sf).select("row_no", "text", "numeric").collect()}
    root = {i: i for i in rows}
    for _ in rows:
        new = {i: min(root[j] for j in rows if i == j or like(rows[i], rows[j], reports.ITEM_CLUSTER)) for i in rows}
        if new == root:
            break
        root = new
    queue = [r["row_no"] for r in views.approval(views.items(spark, sf)).collect()]
    want = {i: sum(like(rows[i], rows[j], reports.ITEM_PROBE) for j in [*rows, *queue]) for i in rows if root[i] == i}
    got = catalog.queries()["item_bulk_check"](spark, sf).collect()
    assert {r["pos"]: r["n_matches"] for r in got} == want
    assert all(r["status"] == "duplicate" for r in got)  # each row is in the main table itself
    groups = {i: ",".join(str(j) for j in sorted(root) if root[j] == i and j != i) for i in want}
    got = {r["representative"]: r["duplicates"] for r in catalog.queries()["item_bulk_groups"](spark, sf).collect()}
    assert got == {i: g for i, g in groups.items() if g}
