import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from kinmatch.llm import op12_divergence as o
from kinmatch.llm import queries


def plain_terms(text):
    out, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or c > "\x7f":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def plain_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(plain_terms(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, c in own for t in c)
        kept = [t for t in df if df[t] >= least]
        groups = {s: Counter() for _, s, _ in own}
        for _, s, c in own:
            groups[s].update({t: c[t] for t in c if df[t] >= least})
        total = sum(groups.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s in groups:
            pairs = [(sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept), x) for x in groups if x != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def made(rng, n, langs, sources, words):
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(words) * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(langs), rng.choice(sources)))
    return rows


@pytest.mark.parametrize("options", [{}, {"rows": 1, "block": 2}, {"rows": 1}, {"top": 2}])
def test_against_plain_audit(spark, monkeypatch, options):
    monkeypatch.setattr(o, "CELLS", 8)
    rng = random.Random(12)
    rows = made(rng, 150, ["en", "fr", "", None], ["a", "b", "é", "", None, "hot", "hot", "hot"], ["The", "a1b", "Été", "x", "_y", "￿", "\U0001f600", "KK", "zz"])
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, term long").repartition(5)
    assert sorted(map(tuple, o.audit(docs, **options).collect())) == plain_audit(rows, top=options.get("top", 200))


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(o, "HELD", 3)
    monkeypatch.setattr(o, "LONG", 10)
    rows = made(random.Random(5), 40, ["en"], ["a", "b"], ["one", "two", "three", "four"])
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    assert sorted(map(tuple, o.audit(docs).collect())) == plain_audit(rows)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.OP12_SQL)
    got = queries.op12_divergence_audit(spark, sf)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_odd_tables(spark):
    kind = "text string, lang string, source string"
    one = spark.createDataFrame([("a b", "en", "s")] * 3, kind)
    assert sorted(map(tuple, o.audit(one).collect())) == plain_audit([("a b", "en", "s")] * 3) == []
    none = spark.createDataFrame([(None, "en", "s"), ("a", "en", "t")], kind)
    assert sorted(map(tuple, o.audit(none).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert o.audit(one.limit(0)).count() == 0
    long = [("word " * 300_000, "en", "s"), ("word x", "en", "t"), ("word", "en", "t")]
    assert sorted(map(tuple, o.audit(spark.createDataFrame(long, kind)).collect())) == plain_audit(long)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.choice([rng.randint(0, 50), rng.randint(10**15, 9 * 10**17 - 10**6)])
        count, terms = rng.randint(0, total), rng.randint(1, 10**5)
        assert o.shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 1) // (total + terms)
