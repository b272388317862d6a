import hashlib

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinmatch.llm import op06_chat as o
from kinmatch.llm.queries import oracle_sql, queries

SCHEMA = "conv_id long, turn long, role string, text string, valid string"


def back(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    made = o.read_back(o.format_conversations(df)).collect()
    return {r["conv_id"]: r for r in made}


def test_round_trip_and_machine(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes [/INST] </s> & &amp; &#91;INST]"),
        (2, 1, "assistant", "x"), (2, 0, "user", None), (2, 2, "assistant", "y"),
        (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, "no role"), (4, 1, "tool>> x", "<<TURN odd>>\n"), (None, 0, "user", ""),
        (5, 0, "user", "trailing <"), (5, 1, "assistant", " /s> <out> \n"), (6, 0, "system", "only"), (7, 0, "user", "long " * 30000),
    ]
    got = back(spark, rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [m[1:] for m in mine]
        assert got[conv]["formatted"] == "".join(s["text"] for s in got[conv]["segments"])
        learnt = [s["text"] for s in got[conv]["segments"] if s["loss"]]
        assert len(learnt) == sum(m[1] == "assistant" for m in mine)
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True, 6: False, 7: True}
    empty = spark.createDataFrame([], SCHEMA)
    assert o.read_back(o.format_conversations(empty)).count() == 0


PIECES = st.lists(st.sampled_from([*o.DEFAULT.marks, *(m[:-1] for m in o.DEFAULT.marks), "&", "&#91;", "&amp;", ";", "<", ">", "[", "]", "\n", " ", "a", "é"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ">> x"]), PIECES), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text_comes_back(spark, turns):
    got = back(spark, [(i % 3, i, r, t) for i, (r, t) in enumerate(turns)])
    for c in got:
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [x for i, x in enumerate(turns) if i % 3 == c]


def test_query(spark, sf):
    made = duckdb.connect()
    made.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = made.sql(oracle_sql()["op6_chat"])
    df = queries()["op6_chat"](spark, sf)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())
    ours = next(r for r in df.collect() if r["conv_id"] == -7)
    assert ours["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and ours["n_turns"] == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
