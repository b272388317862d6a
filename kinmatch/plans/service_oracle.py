"""SQL of the service queries."""

from __future__ import annotations

from .oracle import VENDORS, clusters, norm, probe
from .service import IDENTIFIERS

VIEW = """iv AS (SELECT p_partkey AS id, p_type AS ITEM_TYPE, p_brand AS MAINGROUP, regexp_extract(p_name, '([^ ]+)$', 1) AS SUBGROUP, p_name || ' ' || p_size || 'mm' AS ITEMDESC,
  CASE WHEN p_partkey % 3 = 0 THEN 'C' || p_partkey END AS ITEM_CODE, CASE WHEN p_partkey % 4 = 0 THEN 'pcs' END AS UOM,
  CASE WHEN p_partkey % 5 <> 0 THEN 'sup' END AS Supplier, p_name || ' mm' AS txt, CAST(p_size AS VARCHAR) AS num FROM part),
  item AS (SELECT row_number() OVER (ORDER BY id) AS row_no, * FROM iv)"""
VENDOR_VIEW = f"{VENDORS}, vv AS (SELECT id, Name, CNIC, NTN, STRN AS SalesTaxNo, AccountNo, IBAN AS IbanNO FROM vendor)"
#: The queue's own row numbers are moved so that they differ from those of the main table.
FAR = 1_000_000_000
ITEM_PLACE = f"place AS (SELECT 'db' AS location, row_no, txt, num, ITEMDESC FROM item UNION ALL SELECT 'approval', {FAR} + row_number() OVER (ORDER BY id), txt, num, ITEMDESC FROM item WHERE id % 10 = 0)"
VENDOR_PLACE = f"place AS (SELECT 'db' AS location, row_number() OVER (ORDER BY id) AS row_no, lower(Name) AS txt, '' AS num, * FROM vv UNION ALL SELECT 'approval', {FAR} + row_number() OVER (ORDER BY id), lower(Name), '', * FROM vv WHERE id % 10 = 0)"
ITEM_CLUSTERS = f"WITH RECURSIVE {VIEW}, {clusters('item', 0.985)}"
#: The supplier and the unit stay as far as a code allows.
OPTIONAL = "ITEM_CODE, CASE WHEN ITEM_CODE IS NOT NULL THEN coalesce(UOM, '') ELSE UOM END AS UOM, CASE WHEN ITEM_CODE IS NOT NULL THEN coalesce(Supplier, '') END AS Supplier"
COLUMN = {"CNIC": "CNIC", "NTN": "NTN", "STRN": "SalesTaxNo", "Account No": "AccountNo", "IBAN": "IbanNO"}
BY_LABEL = " UNION ALL ".join(
    f"SELECT '{label}' AS label, 'duplicate' AS status, id, Name, {c} AS field_value, location, row_no % {FAR} AS \"row#\" FROM place WHERE {norm(c)} = {norm(repr(IDENTIFIERS[label]))} AND {norm(c)} <> ''"
    for label, c in COLUMN.items()
)
DIMENSION = r"""([\d.,/~-]+|[\d.]+x[\d.]+(x[\d.]+)?(mm|cm|"|ft|in)?|[\d.]+["''](x[\d.]+["''])+|[\d.,/~-]+ *(mm|cm|in|"|''))"""

SQL = {
    "vendor_scan": f'WITH {VENDOR_VIEW} SELECT row_number() OVER (ORDER BY Name DESC, id) AS row_no, * FROM vv',
    "vendor_approval_scan": f"WITH {VENDOR_VIEW} SELECT row_number() OVER (ORDER BY id) AS row_no, * FROM vv WHERE id % 10 = 0",
    "item_scan_without_id": f"WITH {VIEW} SELECT row_number() OVER (ORDER BY ITEM_TYPE, MAINGROUP, SUBGROUP, ITEMDESC) AS row_no, ITEM_TYPE, MAINGROUP, SUBGROUP, ITEMDESC FROM iv",
    "item_scan_first": f"WITH {VIEW} SELECT row_number() OVER (ORDER BY id DESC) AS row_no, ITEM_TYPE, MAINGROUP, SUBGROUP, ITEMDESC, ITEM_CODE, UOM, Supplier FROM iv ORDER BY id DESC LIMIT 100",
    "item_cache_rows": f"WITH {VIEW} SELECT row_no, txt AS text, num AS numeric, ITEM_TYPE, MAINGROUP, SUBGROUP, ITEMDESC, {OPTIONAL} FROM item",
    "item_json_arrays": f"WITH {VIEW} SELECT row_no, txt AS text, num AS numeric, {OPTIONAL} FROM item",
    "token_classes": f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size || 'mm' WHEN 1 THEN p_size || 'X2in' WHEN 2 THEN p_size || '/2' WHEN 3 THEN p_size || '"x3"' WHEN 4 THEN p_type
      WHEN 5 THEN 'Kg' WHEN 6 THEN 'vdc' ELSE '(w:)' END AS token FROM part)
      SELECT p_partkey, regexp_full_match(lower(token), '{DIMENSION}') AS dimension, lower(token) IN ('kg', 'vdc') AS unit, upper(regexp_replace(token, '[().#,:]', '', 'g')) AS bare FROM t""",
    "embedding_cache_action": "SELECT * FROM (VALUES ('first', 'missing'), ('same', 'reuse'), ('other model', 'compute'), ('changed', 'compute'), ('forced', 'compute')) t(state, action)",
    "engine_item_groups": f"{ITEM_CLUSTERS}, st AS (SELECT group_min, 'DUP_' || dense_rank() OVER (ORDER BY group_min) AS group_id, CASE WHEN count(DISTINCT ITEM_TYPE) = 1 THEN 'exact' ELSE 'different' END AS ITEM_TYPE FROM grp JOIN item USING (row_no) GROUP BY group_min) SELECT group_id, st.ITEM_TYPE, row_no FROM grp JOIN st USING (group_min)",
    "engine_item_totals": f"{ITEM_CLUSTERS}, x AS (SELECT count(*) - count(DISTINCT group_min) AS dup FROM grp), t AS (SELECT count(*) AS n FROM item) SELECT n AS total_records, n - dup AS valid_records, dup AS duplicate_records, round(100.0::DOUBLE * (n - dup) / n, 2) AS Data_quality_score FROM x, t",
    "engine_item_variant": f"WITH {VIEW}, {ITEM_PLACE}, cand AS (SELECT 0::BIGINT AS cand, 'small ring mm' AS txt, '11' AS num), {probe(0.75)} SELECT c.cand, CASE WHEN m.row_no IS NULL THEN 'unique' ELSE 'duplicate' END AS status, ITEMDESC, p.location, p.row_no % {FAR} AS \"row#\" FROM cand c LEFT JOIN m ON m.cand = c.cand LEFT JOIN place p ON p.row_no = m.row_no",
    "engine_item_bulk": f"WITH {VIEW}, {ITEM_PLACE}, cand AS (SELECT * FROM (VALUES (0::BIGINT, 'small ring mm', '11'), (2, 'bolt blue mm', '5'), (3, 'new anvil mm', '77'), (4, 'old rod mm', '20'), (5, '', '')) t(cand, txt, num)), {probe(0.75)} SELECT c.cand, CASE WHEN count(m.row_no) > 0 THEN 'duplicate' ELSE 'unique' END AS status, count(m.row_no) AS n_matches FROM cand c LEFT JOIN m ON m.cand = c.cand GROUP BY c.cand",
    "engine_vendor_report": f"WITH {VENDOR_VIEW}, l AS (" + " UNION ALL ".join(f"SELECT '{label}' AS field, {norm(c)} AS k FROM vv" for label, c in COLUMN.items()) + " UNION ALL SELECT 'NAME', list_aggregate(list_sort(string_split(lower(Name), ' ')), 'string_agg', ' ') FROM vv), g AS (SELECT field, k, count(*) AS n FROM l WHERE k <> '' GROUP BY ALL HAVING count(*) > 1) SELECT field, count(*) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_records FROM g GROUP BY field",
    "engine_vendor_identifiers": f"WITH {VENDOR_VIEW}, {VENDOR_PLACE}, hit AS ({BY_LABEL}), label AS (SELECT unnest(['" + "', '".join(COLUMN) + "']) AS label) SELECT label, coalesce(status, 'unique') AS status, id, Name, field_value, location, \"row#\" FROM label LEFT JOIN hit USING (label)",
    "engine_vendor_name": f"WITH {VENDOR_VIEW}, {VENDOR_PLACE}, c AS (SELECT 0::BIGINT AS cand) SELECT cand, CASE WHEN place.id IS NULL THEN 'unique' ELSE 'duplicate' END AS status, place.id, Name, location, row_no % {FAR} AS \"row#\" FROM c LEFT JOIN place ON txt = 'vendor 12 building'",
    "engine_codes": """WITH code AS (SELECT DISTINCT 'main' AS kind, p_brand AS name FROM part UNION SELECT DISTINCT 'sub', p_type FROM part), v(value, ready) AS (VALUES ('brand#7', 'brand # 7'), ('Economy', 'economy'), (' ', NULL), ('brand 7', 'brand 7')),
      asked AS (SELECT kind, value, ready FROM v CROSS JOIN (VALUES ('main'), ('sub')) k(kind))
      SELECT kind, value, CASE WHEN name IS NULL THEN 'unique' ELSE 'duplicate' END AS status, name FROM asked LEFT JOIN code USING (kind) WHERE name IS NULL OR replace(lower(name), '#', ' # ') = ready
      UNION ALL SELECT kind, value, 'unique', NULL FROM asked WHERE NOT EXISTS (SELECT 1 FROM code WHERE code.kind = asked.kind AND replace(lower(name), '#', ' # ') = ready)""",
    "engine_units": "SELECT * FROM (VALUES ('kgs', 'duplicate', 'Kilogram', 1::BIGINT), ('unit ODD', 'duplicate', 'Odd Unit', 2), ('%', 'unique', '', -1), ('metres', 'duplicate', 'Mtr', 4)) t(value, status, name, id)",
}
