import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.operators.components import connected_components
from kinmatch.operators.grouping import column_status, field_report, field_totals, groups_by_key, numbered, smallest_first, totals
from kinmatch.operators.similarity import token_links, token_pairs, token_weights, vector_pairs


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component_id"] for r in connected_components(df, "a", "b").collect()}


def test_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    assert components(spark, edges) == brute_components(edges)
    assert components(spark, []) == {}


@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(-5, 30)), max_size=40))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_components_of_random_graphs(spark, edges):
    assert components(spark, edges) == brute_components(edges)


def test_token_pairs_equal_brute_force(spark):
    random.seed(3)
    texts = [(i, " ".join(random.choices("abcdef", k=random.randint(1, 5))), random.choice("xy")) for i in range(60)]
    df = spark.createDataFrame(texts, "rep long, t string, k string")

    def cosine(s, t):
        a, b = ({x: u.split().count(x) for x in u.split()} for u in (s, t))
        norm = lambda v: sum(x * x for x in v.values()) ** 0.5
        return sum(n * b.get(x, 0) for x, n in a.items()) / norm(a) / norm(b)

    for threshold in (0.45, 0.9):
        want = {(i, j) for i, s, k in texts for j, t, m in texts if i < j and k == m and cosine(s, t) >= threshold - 1e-12}
        w = token_weights(df)
        assert {(r["a"], r["b"]) for r in token_pairs(w, w, threshold, own=True).collect()} == want
        for sizes in ({}, {"bucket": 3, "small": 5}):
            links = token_links(w, threshold, **sizes)
            assert {r["node"]: r["component_id"] for r in connected_components(links, "a", "b").collect()} == brute_components(want)


def test_near_copies_of_a_text_give_few_links(spark):
    """4,000 rows that are all similar: no row for a pair, a few links a row, no task with more than two parts."""
    n = 4000
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + f" x{i}", "k") for i in range(n)]
    links = token_links(token_weights(spark.createDataFrame(rows, "rep long, t string, k string")), 0.9, bucket=1000)
    assert links.count() < 8 * n
    assert {r["component_id"] for r in connected_components(links, "a", "b").collect()} == {0}


def test_vector_pairs_in_blocks(spark):
    random.seed(4)
    rows = [(i, [random.gauss(0, 1) for _ in range(3)], i % 2 if i % 7 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, v array<double>, k int")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, j) for i, v, k in rows for j, w, m in rows if i < j and k == m and dot(v, w) >= 1.0}
    for block in (9, 1000):
        got = [(r["a"], r["b"]) for r in vector_pairs(df, "i", "v", 1.0, F.col("k"), block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_groups_and_reports(spark):
    rows = [(1, "a1", "Red"), (2, "A-1", " red "), (3, "", "x"), (4, None, "x"), (5, "b", "y"), (6, "B", "z")]
    df = spark.createDataFrame(rows, "row_no long, ident string, color string")
    groups = groups_by_key(df, F.upper(F.regexp_replace(F.coalesce("ident", F.lit("")), "[^A-Za-z0-9]", "")))
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (2, 1), (5, 5), (6, 5)]
    assert {(r["row_no"], r["group_id"]) for r in numbered(groups).collect()} == {(1, "DUP_1"), (2, "DUP_1"), (5, "DUP_2"), (6, "DUP_2")}
    assert totals(df, groups).first().asDict() == {"total_records": 6, "valid_records": 4, "duplicate_records": 2, "Data_quality_score": 66.67}
    status = {r["group_min"]: (r["color"], r["ITEMDESC"]) for r in column_status(df.withColumn("ITEMDESC", F.lit("x")), groups, ["color", "ITEMDESC"]).collect()}
    assert status == {1: ("exact", "different"), 5: ("different", "different")}
    assert sorted((r[0], r[1]) for r in smallest_first(groups).collect()) == [(1, [2]), (5, [6])]
    report = field_report(df.withColumn("id", F.col("row_no") * 10), ["ident"])
    assert [tuple(r) for r in field_totals(report).collect()] == [("ident", 2, 2)]
    empty = df.where("false")
    assert totals(empty, groups.where("false")).first()["Data_quality_score"] == 0.0


def test_vectors_of_all_kinds(spark):
    """Null vectors, null components and other lengths have no pairs; candidates without a key in blocks lose none."""
    from kinmatch.operators.similarity import vector_pairs, vector_probe

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [None, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [(r["a"], r["b"]) for r in vector_pairs(df, "id", "v", 0.9, block=2).collect()] == [(1, 2)]
    rng = random.Random(4)
    many = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(many, "id long, v array<double>")
    want = {(i, j) for i, x in many[:15] for j, y in many if sum(a * b for a, b in zip(x, y)) >= 0.5}
    given = df.where("id < 15").withColumnRenamed("id", "cand")
    for block in (4, 1000):
        got = [(r["cand"], r["id"]) for r in vector_probe(given, df, 0.5, False, block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert vector_probe(given.where("false"), df, 0.5, False).count() == 0


def test_row_numbers_leave_columns_alone(spark):
    from kinmatch.sources.tables import with_row_no

    df = spark.createDataFrame([(2, "a", 7, 8), (1, "b", 9, 10)], "id long, _part string, _own int, _skip int")
    made = with_row_no(df, [F.col("id").asc()])
    assert made.columns == [*df.columns, "row_no"] and [tuple(r) for r in made.orderBy("id").collect()] == [(1, "b", 9, 10, 1), (2, "a", 7, 8, 2)]
