"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op01_grid_join,
    op02_packing,
    op03_token_counts,
    op04_iblt,
    op05_simhash,
    op06_chat,
    op07_quality,
    op08_byte_bpe,
    op09_toxicity,
    op10_html as op10_html_operator,
    op11_licences,
    op12_divergence,
    op13_centroids,
)
from .common import crc_mod5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_grid_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = op02_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op04_iblt.fingerprints(op04_iblt.edited_pairs(_table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": said}
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = op06_chat.read_back(op06_chat.format_conversations(turns))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op08_byte_bpe.encode(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return made.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _scored(op07_quality.score(docs, op07_quality.fit(docs, _table(spark, sf_dir, "labels"))), 0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _scored(op09_toxicity.score(docs, op09_toxicity.fit(docs, _table(spark, sf_dir, "labels"))), 0.5)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html_operator.extract(_table(spark, sf_dir, "pages"))


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_licences.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_centroids.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_grid_join": op1_grid_join,
        "op2_packing": op2_packing,
        "op3_token_counts": op3_token_counts,
        "op4_iblt": op4_iblt,
        "op5_simhash": op5_simhash,
        "op6_chat": op6_chat,
        "op7_quality": op7_quality,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_html": op10_html,
        "op11_licence_scan": op11_licence_scan,
        "op12_divergence_audit": op12_divergence_audit,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


#: All links, not a spanning forest of them; components by repeated minima, as far as they spread in these data.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings WHERE vec_id IS NOT NULL),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.x, b.x) >= 0.9),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c
"""

OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, {escaped} AS x,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + {frame})::BIGINT AS formatted_chars,
  bool_and({move}) AND bool_or(last AND role IN ({ends})) AS valid
FROM e GROUP BY conv_id
"""


def _op6_sql() -> str:
    t = op06_chat.DEFAULT
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = "replace(text, '&', '&amp;')"
    for m in sorted(t.marks, key=len, reverse=True):
        escaped = f"replace({escaped}, {quoted(m)}, {quoted(op06_chat._code(m))})"
    frame = " ".join(f"WHEN '{r}' THEN {len(k.begin) + len(k.end)}" for r, k in t.turns)
    return OP6_SQL.format(
        escaped=escaped,
        frame=f"CASE role {frame} ELSE {len(t.other_begin + t.other_mid + t.other_end)} + length(role) END",
        move=" OR ".join(f"(before = '{a}' AND role = '{b}')" for a, b in t.moves),
        ends=", ".join(f"'{x}'" for x in t.ends),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(c.n)::HUGEINT AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(n.total, 0) + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round is two steps: rows to their nearest centroids, then floors of the means of those that have rows."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d "
            f"FROM v JOIN c{i} c USING (i) GROUP BY v.r, c.k) GROUP BY r)"
        )
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{i} a USING (r) GROUP BY a.k, v.i), "
                f"c{i + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{i} c LEFT JOIN m{i} USING (k, i))"
            )
    finite = "len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    return f"""
WITH e AS (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings WHERE {finite}),
v AS MATERIALIZED (
  SELECT r, generate_subscripts(embedding, 1) AS i, floor(1024 * unnest(embedding)::DOUBLE)::HUGEINT AS x FROM e),
f AS (
  SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS k FROM e QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT f.k, v.i, v.x FROM f JOIN v USING (r)),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY k)
SELECT e.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.digest AS centroid_sha256
FROM e JOIN a{rounds} a USING (r) JOIN h USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_grid_join": OP1_SQL, "op6_chat": _op6_sql(), "op12_divergence_audit": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
