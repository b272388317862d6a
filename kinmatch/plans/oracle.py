"""The same results in DuckDB's SQL, stated without the engine's operators."""

from __future__ import annotations

from ..functions import uom
from .catalog import CATALOG_UNITS, UNITS
from .views import FIELDS, VENDOR

ITEM = """item AS (
  SELECT p_partkey AS row_no, p_type AS ITEM_TYPE, p_brand AS MAINGROUP, regexp_extract(p_name, '([^ ]+)$', 1) AS SUBGROUP,
    p_name || ' ' || p_size || 'mm' AS ITEMDESC, p_name || ' mm' AS txt, CAST(p_size AS VARCHAR) AS num FROM part)"""
VENDORS = "vendor AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in VENDOR.items()) + " FROM customer)"


def norm(c: str) -> str:
    kept = f"regexp_replace(coalesce({c}, ''), '[^a-zA-Z0-9]', '', 'g')"
    return f"(CASE WHEN regexp_full_match({kept}, '[0-9]+') THEN coalesce(nullif(ltrim({kept}, '0'), ''), '0') ELSE upper({kept}) END)"


def tokens(name: str, source: str) -> str:
    """Unit token weights, w, of (rep, txt, num) rows."""
    return f"""{name}_t AS (SELECT rep, num, tok, count(*) AS tf FROM (SELECT rep, num, unnest(string_split(lower(txt), ' ')) AS tok FROM {source})
    WHERE tok <> '' GROUP BY ALL),
  {name} AS (SELECT rep, num, tok, tf / sqrt(sum(tf * tf) OVER (PARTITION BY rep)) AS w FROM {name}_t)"""


def clusters(source: str, threshold: float) -> str:
    """grp(row_no, group_min) of (row_no, txt, num) rows, by distinct texts."""
    return f"""d AS (SELECT txt, num, min(row_no) AS rep, count(*) AS n FROM {source} GROUP BY txt, num), {tokens("w", "d")},
  e AS (SELECT a.rep AS a, b.rep AS b FROM w a JOIN w b ON a.num = b.num AND a.tok = b.tok AND a.rep <> b.rep
    GROUP BY a.rep, b.rep HAVING sum(a.w * b.w) >= {threshold} - 1e-12),
  r(rep, root) AS (SELECT rep, rep FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.rep),
  c AS (SELECT rep, min(root) AS group_min FROM r GROUP BY rep),
  g AS (SELECT group_min FROM c JOIN d USING (rep) GROUP BY group_min HAVING sum(n) > 1),
  grp AS (SELECT s.row_no, c.group_min FROM {source} s JOIN d USING (txt, num) JOIN c USING (rep) JOIN g USING (group_min))"""


def probe(threshold: float) -> str:
    """Matches of cand(cand, txt, num) in place(location, row_no, txt, num)."""
    return f"""cd AS (SELECT cand AS rep, txt, num FROM cand), {tokens("cw", "cd")},
  pd AS (SELECT row_number() OVER (ORDER BY txt, num) AS rep, txt, num FROM place GROUP BY txt, num), {tokens("pw", "pd")},
  hit AS (SELECT a.rep AS cand, b.rep FROM cw a JOIN pw b ON a.num = b.num AND a.tok = b.tok GROUP BY a.rep, b.rep HAVING sum(a.w * b.w) >= {threshold} - 1e-12
    UNION ALL SELECT cd.rep, pd.rep FROM cd JOIN pd ON cd.num = pd.num WHERE cd.txt = '' AND pd.txt = ''),
  m AS (SELECT hit.cand, place.location, place.row_no FROM hit JOIN pd USING (rep) JOIN place USING (txt, num))"""


ITEM_CLUSTERS = f"WITH RECURSIVE {ITEM}, {clusters('item', 0.985)}"
LOCATED = "place AS (SELECT 'db' AS location, * FROM {s} UNION ALL SELECT 'approval', * FROM {s} WHERE row_no % 10 = 0)"
LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, row_no, id, {f} AS value, {norm(f)} AS k FROM vendor" for f in FIELDS)
REPORT = f"""WITH {VENDORS}, l AS ({LONG}),
  s AS (SELECT field, k, min(row_no) AS group_min FROM l WHERE k <> '' GROUP BY field, k HAVING count(*) > 1),
  rep AS (SELECT l.field, s.group_min, l.id, coalesce(l.value, '') AS value FROM l JOIN s USING (field, k))"""
COSINE = "array_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64])"
PRODUCT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
BULK = f"""WITH RECURSIVE {ITEM}, batch AS (SELECT * FROM item), {clusters('batch', 0.985)},
  cand AS (SELECT row_no AS cand, txt, num FROM batch WHERE row_no NOT IN (SELECT row_no FROM grp WHERE row_no <> group_min)),
  place AS (SELECT 'db' AS location, row_no, txt, num FROM item UNION ALL SELECT 'approval', row_no, txt, num FROM item WHERE row_no % 10 = 0),
  {probe(0.75)}"""
KEY = "regexp_replace(lower(trim({c})), '[^a-z0-9]', '', 'g')"
#: alias(k, unit): of the labels with one key, the last.
ALIASES = ", ".join(f"({i}, '{label}', '{unit}')" for i, (unit, label) in enumerate((u, x) for u, labels in uom.UNITS.items() for x in [*labels, u]))
ALIAS = f"alias AS (SELECT {KEY.format(c='label')} AS k, arg_max(unit, place) AS unit FROM (VALUES {ALIASES}) t(place, label, unit) GROUP BY 1 HAVING k <> '')"


def canonical(source: str) -> str:
    """``source``'s rows with the unit code of their ``value``; an unknown one is its own key."""
    return f"(SELECT s.*, coalesce(unit, upper({KEY.format(c='value')})) AS code FROM {source} s LEFT JOIN alias ON alias.k = {KEY.format(c='value')})"


def picked(labels: tuple[str, ...]) -> str:
    """``(p_partkey, value)``: the labels in turn."""
    cases = " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(labels))
    return f"(SELECT p_partkey, CASE p_partkey % {len(labels)} {cases} END AS value FROM part)"


CASCADE = f"""WITH {ALIAS}, cat AS (SELECT id, value, code FROM {canonical("(SELECT id, trim(label) AS value FROM (VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(CATALOG_UNITS, 1)) + ") t(id, label))")}),
  ask AS (SELECT p_partkey AS cand, value, code FROM {canonical(picked((*UNITS, "unit ODD")))} WHERE code <> ''),
  same AS (SELECT cand, id FROM ask JOIN cat USING (code) WHERE cat.value <> ''),
  cand AS (SELECT cand, value AS txt, '' AS num FROM ask WHERE cand NOT IN (SELECT cand FROM same)),
  place AS (SELECT 'db' AS location, id AS row_no, value AS txt, '' AS num FROM cat), {probe(0.97)}
  SELECT cand, id::BIGINT AS id, 'alias' AS how FROM same UNION ALL SELECT cand, row_no::BIGINT, 'similar' FROM m"""

#: Colours are never corrected; no other word of the table is a unit or a term of the domain.
SPELL = """WITH w AS (SELECT lower(unnest(string_split(p_name, ' '))) AS term FROM part),
  term AS (SELECT term, count(*) AS f FROM w WHERE length(term) > 2 GROUP BY term),
  typed AS (SELECT p_partkey, unnest(string_split(replace(replace(p_name, 'll', 'l'), 'dge', 'deg'), ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part),
  near AS (SELECT word, term, f, damerau_levenshtein(word, term) AS edits FROM (SELECT DISTINCT word FROM typed) JOIN term ON damerau_levenshtein(word, term) <= 2 WHERE word NOT IN ('red', 'blue')),
  best AS (SELECT word, term, edits FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, f DESC, term) = 1)
  SELECT p_partkey, string_agg(CASE WHEN edits > 0 THEN upper(term) ELSE word END, ' ' ORDER BY place) || ' 20mm STEEL kgs' AS corrected
  FROM typed LEFT JOIN best USING (word) GROUP BY p_partkey"""
NORMAL = "p_name || ' IM # ' || p_partkey || ' PRONG: ' || p_size || ' 1.5 x 40s A 10-12 ' || p_size || ' GSM x'"

STATUS = ", ".join(f"CASE WHEN count(DISTINCT lower(trim({c}))) = 1 THEN 'exact' ELSE 'different' END AS {c}_status" for c in ("ITEM_TYPE", "MAINGROUP", "SUBGROUP")) + ", 'different' AS ITEMDESC_status"  # a description's status is fixed
NAMED = f"WITH RECURSIVE {VENDORS}, v AS (SELECT row_no, Name AS txt, '' AS num FROM vendor), {clusters('v', 0.9)}, l AS ({LONG}), s AS (SELECT field, k, min(row_no) AS group_min FROM l WHERE k <> '' GROUP BY field, k HAVING count(*) > 1), rep AS (SELECT l.field, s.group_min, l.id, coalesce(l.value, '') AS value FROM l JOIN s USING (field, k) UNION ALL SELECT 'NAME', grp.group_min, vendor.id, vendor.Name FROM grp JOIN vendor USING (row_no))"
SQL = {
    "vendor_duplicate_report": f"{NAMED} SELECT * FROM rep",
    "vendor_duplicate_totals": f"{NAMED}, z AS (SELECT field, group_min, count(*) AS n FROM rep GROUP BY ALL) SELECT field, count(*) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_records FROM z GROUP BY field",
    "item_duplicate_report_records": f"{ITEM_CLUSTERS}, st AS (SELECT group_min, 'DUP_' || dense_rank() OVER (ORDER BY group_min) AS group_id, {STATUS} FROM grp JOIN item USING (row_no) GROUP BY group_min) SELECT group_id, ITEM_TYPE_status, MAINGROUP_status, SUBGROUP_status, ITEMDESC_status, row_no, ITEM_TYPE, MAINGROUP, SUBGROUP, ITEMDESC FROM st JOIN grp USING (group_min) JOIN item USING (row_no)",
    "item_bulk_summary": f"{ITEM_CLUSTERS} SELECT (SELECT count(*) FROM item) AS total_submitted, (SELECT count(*) FROM item) - (SELECT count(*) - count(DISTINCT group_min) FROM grp) AS unique_count, (SELECT count(DISTINCT group_min) FROM grp) AS duplicate_groups",
    "vendor_identifier_groups": f"WITH {VENDORS}, k AS (SELECT row_no, {norm('NTN')} AS k FROM vendor), g AS (SELECT k, min(row_no) AS group_min FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1) SELECT row_no, group_min FROM k JOIN g USING (k)",
    "vendor_field_report": f"{REPORT} SELECT * FROM rep",
    "vendor_components_updated": f"""{REPORT.replace("WITH", "WITH RECURSIVE", 1)},
      e AS (SELECT id AS a, group_min AS b FROM rep WHERE id <> group_min UNION SELECT group_min, id FROM rep WHERE id <> group_min),
      r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
      SELECT node, min(root) AS component_id FROM r GROUP BY node""",
    "vendor_field_totals": f"{REPORT}, z AS (SELECT field, group_min, count(*) AS n FROM rep GROUP BY ALL) SELECT field, count(*) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_records FROM z GROUP BY field",
    "vendor_name_groups": f"WITH RECURSIVE {VENDORS}, v AS (SELECT row_no, Name AS txt, '' AS num FROM vendor), {clusters('v', 0.9)} SELECT * FROM grp",
    "vendor_identifier_probe": f"WITH {VENDORS}, {LOCATED.format(s='vendor')}, k AS (SELECT row_no AS cand, {norm('NTN')} AS k FROM vendor WHERE row_no % 100 = 0) SELECT k.cand, p.location, p.id, p.NTN AS field_value FROM place p JOIN k ON k.k = {norm('p.NTN')} WHERE k.k <> ''",
    "vendor_name_probe": f"WITH {VENDORS}, v AS (SELECT row_no, Name AS txt, '' AS num FROM vendor), {LOCATED.format(s='v')}, cand AS (SELECT row_no AS cand, upper(txt) AS txt, num FROM v WHERE row_no % 100 = 0), {probe(0.97)} SELECT * FROM m",
    "clean_str": "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN '' WHEN event_id % 6 = 3 THEN 'none' ELSE event_type END AS cleaned FROM events",
    "normalize_identifier": f"WITH {VENDORS} SELECT row_no, {', '.join(f'{norm(f)} AS {f}' for f in FIELDS)} FROM vendor",
    "uom_canonical": f"WITH {ALIAS} SELECT p_partkey, code AS canonical FROM {canonical(picked(UNITS))}",
    "item_text_numeric_split": f"WITH {ITEM} SELECT row_no, txt AS text, num AS numeric FROM item",
    "item_scan_ordered": "SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand DESC NULLS LAST, p_partkey) AS row_no FROM part",
    "catalog_scan": "SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand AS text FROM (SELECT DISTINCT p_brand FROM part)",
    "approval_union": f"WITH {ITEM}, {LOCATED.format(s='item')} SELECT location, count(*) AS n, count(DISTINCT ITEMDESC) AS n_descriptions FROM place GROUP BY location",
    "rows_round_trip": f"WITH {ITEM} SELECT CAST(row_no AS VARCHAR) AS row_no, txt AS text, num AS numeric, ITEM_TYPE FROM item",
    "vector_pairs_blocked": f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND {PRODUCT} >= 0.35",
    "vector_pairs_unblocked": f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {PRODUCT} >= 0.35",
    "vector_exact_groups": "SELECT min(vec_id) AS group_min, count(*) AS size FROM (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 5 = 0) GROUP BY embedding HAVING count(*) > 1",
    "vector_components": f"WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {PRODUCT} >= 0.35), r(vec_id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id) SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id",
    "vector_probe": f"SELECT a.vec_id AS cand, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND {PRODUCT} >= 0.35",
    "item_duplicate_report": f"{ITEM_CLUSTERS} SELECT 'DUP_' || dense_rank() OVER (ORDER BY group_min) AS group_id, row_no, ITEM_TYPE, MAINGROUP, SUBGROUP, ITEMDESC FROM grp JOIN item USING (row_no)",
    "item_quality_score": f"{ITEM_CLUSTERS}, x AS (SELECT count(*) - count(DISTINCT group_min) AS dup FROM grp), t AS (SELECT count(*) AS n FROM item) SELECT n AS total_records, n - dup AS valid_records, dup AS duplicate_records, round(100.0::DOUBLE * (n - dup) / n, 2) AS Data_quality_score FROM x, t",
    "item_column_status": f"{ITEM_CLUSTERS} SELECT group_min, " + ", ".join(f"CASE WHEN count(DISTINCT lower(trim({c}))) = 1 THEN 'exact' ELSE 'different' END AS {c}" for c in ("ITEM_TYPE", "MAINGROUP", "SUBGROUP")) + ", 'different' AS ITEMDESC FROM grp JOIN item USING (row_no) GROUP BY group_min",
    "item_variant_probe": f"WITH {ITEM}, i AS (SELECT row_no, txt, num FROM item), {LOCATED.format(s='i')}, cand AS (SELECT * FROM (VALUES (1::BIGINT, 'SMALL ring mm', '11'), (2, 'red bolt small MM', '28'), (3, '', '')) t(cand, txt, num)), {probe(0.75)} SELECT * FROM m",
    "item_match_counts": f"WITH {ITEM}, i AS (SELECT row_no, txt, num FROM item), {LOCATED.format(s='i')}, cand AS (SELECT * FROM (VALUES (1::BIGINT, 'SMALL ring mm', '11'), (2, 'red bolt small MM', '28'), (3, '', '')) t(cand, txt, num)), {probe(0.75)} SELECT location, count(*) AS n FROM m GROUP BY location",
    "item_bulk_check": f"{BULK}, n AS (SELECT cand, count(*) AS n FROM m GROUP BY cand) SELECT cand.cand AS pos, CASE WHEN n.n > 0 THEN 'duplicate' ELSE 'unique' END AS status, coalesce(n.n, 0) AS n_matches FROM cand LEFT JOIN n USING (cand)",
    "item_bulk_groups": f"{BULK} SELECT group_min AS representative, string_agg(row_no, ',' ORDER BY row_no) FILTER (row_no <> group_min) AS duplicates FROM grp GROUP BY group_min",
    "catalog_probe": f"WITH u AS (SELECT 'main' AS location, p_brand AS txt FROM part UNION ALL SELECT 'sub', p_type FROM part), place AS (SELECT location, count(*) AS row_no, txt, '' AS num FROM u GROUP BY location, txt), cand AS (SELECT * FROM (VALUES (1::BIGINT, 'brand#7', ''), (2, 'Economy', ''), (3, 'Brand#7 Economy', ''), (4, '!!!', '')) t(cand, txt, num)), {probe(0.97)} SELECT * FROM m",
    "uom_cascade": CASCADE,
    "spell_correct": SPELL,
    "item_normalize_full": f"SELECT p_partkey, {NORMAL} AS normal, p_name || ' IM # PRONG: x A GSM x' AS text, p_partkey || ' ' || p_size || ' 1.5 40s 10-12 ' || p_size AS numeric FROM part",
    "next_refresh_slot": "SELECT event_id, date_trunc('day', ts) + to_hours(4 * (CAST(floor(date_part('hour', ts) / 4) AS INTEGER) + 1)) AS slot FROM events",
    "embedding_refresh_summary": "SELECT count(*) AS total, 128::BIGINT AS dim, 'hashed-tokens-8-128' AS model, 'complete' AS status FROM part",
}

SQL["item_variant_probe_indexed"] = SQL["item_variant_probe"]
SQL["vendor_name_probe_indexed"] = (
    f"WITH {VENDORS}, v AS (SELECT row_no, Name AS txt, '' AS num FROM vendor), {LOCATED.format(s='v')}, "
    f"cand AS (SELECT min(row_no) AS cand, upper(txt) AS txt, num FROM v GROUP BY upper(txt), num), {probe(0.97)} "
    "SELECT cand, location, count(*) AS n FROM m GROUP BY cand, location"
)
SQL["embedding_refresh_ranges"] = (
    f"WITH {ITEM}, changed AS (SELECT row_no, CASE WHEN row_no = (SELECT max(row_no) FROM item) THEN txt || ' changed' ELSE txt END AS txt FROM item) "
    "SELECT CAST(floor((row_no - 1) / 256) AS BIGINT) AS range_no, count(*) AS n, max(row_no) = (SELECT max(row_no) FROM item) AS made_again, max(txt) AS last_text, max(length(txt)) AS longest FROM changed GROUP BY range_no"
)
