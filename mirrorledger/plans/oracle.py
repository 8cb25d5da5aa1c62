"""The registered queries once more, as plain SQL over the given tables, for an independent engine to run.

The SQL follows the definitions directly (candidate lists ranked by window functions), not the joins of the Spark side.
"""

from ..functions import constants as K
from . import trees


def _strings(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_CATEGORY = f"""CASE WHEN lower(ext) IN ({_strings(K.RAW_PHOTO_EXTENSIONS)}) THEN 'PhotoRaw'
  WHEN lower(ext) IN ({_strings(K.STANDARD_PHOTO_EXTENSIONS)}) THEN 'PhotoStandard'
  WHEN lower(ext) IN ({_strings(K.VIDEO_EXTENSIONS)}) THEN 'Video'
  WHEN lower(ext) IN ({_strings(K.SIDECAR_EXTENSIONS)}) THEN 'Sidecar' ELSE 'Other' END"""

_DOC_EXT = "CASE lang WHEN 'en' THEN '.JPG' WHEN 'fr' THEN '.CR3' WHEN 'de' THEN '.MOV' ELSE '.XMP' END"
_DOC_PATH = f"lang || '/' || source || '_' || doc_id || {_DOC_EXT}"
_MTIME = "make_timestamp((1704067200 + n_chars) * 1000000)"

TREES = f"""
raw_files AS (
  SELECT 'card' AS root_id, '/media/card/' AS base, {_DOC_PATH} AS rel, text AS body, {_MTIME} AS mtime FROM documents
  UNION ALL SELECT 'card', '/media/card/', 'chat/' || conv_id || '_' || turn || '.mp4', text, NULL FROM conversations
  UNION ALL SELECT 'card', '/media/card/', 'web/' || page_id || '.tiff', html, NULL FROM pages
  UNION ALL SELECT 'card', '/media/card/', 'bench/' || item_id || '.iiq', text, NULL FROM benchmark
  UNION ALL SELECT 'ssd', '/mnt/ssd/',
      CASE WHEN lang = 'fr' AND source <> 'src5' THEN 'Archive/' || source || '/' || doc_id || {_DOC_EXT}
           ELSE {_DOC_PATH} END,
      CASE WHEN source = 'src5' THEN translate(text, 'a', '4') ELSE text END, {_MTIME}
    FROM documents WHERE source <> 'src3'
  UNION ALL SELECT 'ssd', '/mnt/ssd/', lang || '/' || source || '_' || doc_id || '_2' || {_DOC_EXT}, text, {_MTIME}
    FROM documents WHERE source = 'src5'
  UNION ALL SELECT 'ssd', '/mnt/ssd/', 'chat/' || conv_id || '_' || turn || '.mp4', text, NULL FROM conversations
  UNION ALL SELECT 'nas', '/nas/', {_DOC_PATH},
      CASE WHEN source = 'src11' AND length(text) > 300
             THEN substr(text, 1, 100) || translate(substr(text, 101, length(text) - 200), 'e', '3')
                  || substr(text, length(text) - 99)
           WHEN source = 'src13' THEN translate(text, 'a', '4') ELSE text END, {_MTIME}
    FROM documents WHERE source <> 'src4'
  UNION ALL SELECT 'nas', '/nas/', 'pages/p' || page_id || '.tiff', html, NULL FROM pages
),
files AS (
  SELECT root_id, rel AS relative_path, base || rel AS full_path, octet_length(encode(body)) AS file_length,
         mtime, encode(body) AS content, regexp_extract(rel, '\\.[^.]*$') AS ext, upper(rel) AS path_key,
         upper(regexp_extract(rel, '[^/]*$')) AS name_key
  FROM raw_files
),
inv AS (SELECT *, {_CATEGORY} AS category FROM files)"""


def _interior(positions, size, edge):
    """Slices as (offset, length) lists before the 'after the previous slice' rule."""
    parts = []
    for p in positions:
        wanted = f"CAST(floor(file_length * CAST({p} AS DOUBLE)) AS BIGINT) - {size // 2}"
        offset = f"least(greatest({wanted}, {edge}), greatest({edge}, file_length - {edge} - {size}))"
        parts.append(
            f"{{'o': {offset}, 'n': least({size}, greatest(0, file_length - {offset} - {edge}))}}"
        )
    tail = f"greatest({edge}, file_length - {edge})"
    parts.append(f"{{'o': {tail}, 'n': least({edge}, file_length - {tail})}}")
    return "[" + ", ".join(parts) + "]"


def _probe(t):
    """A lateral CTE chain that keeps each slice with bytes that starts after the last kept one."""
    tier2 = _interior(t.tier2_positions, t.tier2_slice, t.edge)
    tier3 = _interior(t.tier3_positions, t.tier3_slice, t.edge)
    raw = f"""CASE WHEN file_length <= {t.tier1_max} THEN []
      WHEN file_length <= {t.tier2_max} THEN {tier2} ELSE {tier3} END"""
    start = f"""CASE WHEN file_length <= {t.tier1_max} THEN [{{'o': CAST(0 AS BIGINT), 'n': CAST(file_length AS BIGINT)}}]
      ELSE [{{'o': CAST(0 AS BIGINT), 'n': CAST(least({t.edge}, file_length) AS BIGINT)}}] END"""
    steps = [f"probe0 AS (SELECT full_path, root_id, file_length, content, {raw} AS raw, {start} AS plan FROM inv)"]
    for i in range(1, 9):
        steps.append(
            f"""probe{i} AS (SELECT full_path, root_id, file_length, content, raw,
  CASE WHEN len(raw) >= {i} AND raw[{i}].n > 0 AND raw[{i}].o > plan[-1].o
       THEN list_append(plan, {{'o': CAST(raw[{i}].o AS BIGINT), 'n': CAST(raw[{i}].n AS BIGINT)}}) ELSE plan END AS plan
  FROM probe{i - 1})"""
        )
    pieces = " || ".join(
        f"CASE WHEN len(plan) >= {i} THEN array_slice(content, plan[{i}].o + 1, plan[{i}].o + plan[{i}].n) "
        f"ELSE encode('') END"
        for i in range(1, 10)
    )
    steps.append(f"deep AS (SELECT full_path, root_id, plan, md5({pieces}) AS deep_fp FROM probe8)")
    return ",\n".join(steps)


_C = trees.CHUNK
PROBE = _probe(trees.TIERS)
FINGERPRINTED = f"""{TREES},
{PROBE},
fp AS (
  SELECT i.root_id, i.relative_path, i.full_path, i.file_length, i.mtime, i.category, i.path_key, i.name_key,
         md5(array_slice(i.content, 1, {_C})) AS head_fp,
         md5(array_slice(i.content, greatest(file_length - {_C} + 1, 1), file_length)) AS tail_fp,
         d.deep_fp, md5(i.content) AS full_fp
  FROM inv i JOIN deep d USING (root_id, full_path)
)"""

_HEX = "'0x' || upper(substr({}, 1, 16))"
_EQUAL = {
    "Quick": "c.head_fp = s.head_fp AND c.tail_fp = s.tail_fp",
    "Deep": "c.deep_fp = s.deep_fp",
    "Full": "c.full_fp = s.full_fp",
}
_SHOWN = {
    "SuperFast": [],
    "Quick": ["head_fp", "tail_fp"],
    "Deep": ["deep_fp"],
    "Full": ["head_fp", "tail_fp", "full_fp"],
}
_CORRUPT = {"Quick": K.REASON_QUICK_CORRUPT, "Deep": K.REASON_DEEP_CORRUPT, "Full": K.REASON_FULL_CORRUPT}
_MISSING = {"Quick": K.REASON_QUICK_MISSING, "Deep": K.REASON_DEEP_MISSING, "Full": K.REASON_FULL_MISSING}


def match_ctes(mode: str) -> str:
    """``matches``: one row per (card file, destination); ``file_status``: one row per card file."""
    base = TREES + f""",
fp AS (SELECT root_id, relative_path, full_path, file_length, mtime, category, path_key, name_key,
  NULL::VARCHAR AS head_fp, NULL::VARCHAR AS tail_fp, NULL::VARCHAR AS deep_fp, NULL::VARCHAR AS full_fp FROM inv)"""
    if mode != "SuperFast":
        base = FINGERPRINTED
    shown = {f: (f"r.{f}" if f in _SHOWN[mode] else "NULL::VARCHAR") for f in ["head_fp", "tail_fp", "deep_fp", "full_fp"]}
    common = f"""{base},
dests AS (SELECT * FROM (VALUES (0, 'ssd', '/mnt/ssd'), (1, 'nas', '')) v(dest_order, dest_id, root_path)),
src AS (SELECT * FROM fp WHERE root_id = 'card'),
pairs AS (SELECT s.full_path AS source_path, d.dest_id, c.full_path AS cand_path,
    (c.path_key = s.path_key) AS same_path, (c.name_key = s.name_key) AS same_name,
    c.path_key, c.relative_path AS cand_rel, c.head_fp = s.head_fp AS head_equal,
    c.head_fp = s.head_fp AND c.tail_fp = s.tail_fp AS edges_equal,
    {_EQUAL.get(mode, 'FALSE')} AS equal
  FROM src s JOIN fp c ON c.file_length = s.file_length AND c.root_id <> 'card'
  JOIN dests d ON d.dest_id = c.root_id),
ranked AS (SELECT *, count(*) OVER w0 AS n,
    row_number() OVER (w0 ORDER BY same_path DESC, same_name DESC, path_key, cand_rel) AS any_rank,
    row_number() OVER (w0 ORDER BY equal DESC, same_path DESC, same_name DESC, path_key, cand_rel) AS equal_rank,
  FROM pairs WINDOW w0 AS (PARTITION BY source_path, dest_id)),
best AS (SELECT source_path, dest_id, max(n) AS n,
    max(CASE WHEN any_rank = 1 THEN cand_path END) AS first_path,
    bool_or(any_rank = 1 AND same_path) AS first_same_path, bool_or(any_rank = 1 AND same_name) AS first_same_name,
    max(CASE WHEN equal_rank = 1 AND equal THEN cand_path END) AS equal_path,
    max(CASE WHEN any_rank = 1 AND same_path THEN cand_path END) AS same_path_path,
    bool_or(any_rank = 1 AND head_equal) AS first_head_equal
  FROM ranked GROUP BY source_path, dest_id),"""
    if mode == "SuperFast":
        judged = f"""
judged AS (SELECT s.*, d.dest_order, d.dest_id, d.root_path,
    CASE WHEN first_same_path OR first_same_name OR n = 1 THEN 'Verified' ELSE 'Missing' END AS status,
    CASE WHEN first_same_path OR first_same_name OR n = 1 THEN first_path END AS matched_path,
    CASE WHEN n IS NULL THEN '{K.REASON_NO_SIZE}'
         WHEN first_same_path OR first_same_name OR n = 1 THEN NULL
         ELSE '{K.REASON_AMBIGUOUS}' END AS failure_reason
  FROM src s CROSS JOIN dests d LEFT JOIN best b ON b.source_path = s.full_path AND b.dest_id = d.dest_id),"""
    else:
        corrupt = f"'{_CORRUPT[mode]}'"
        if mode == "Full":
            corrupt = f"CASE WHEN n = 1 AND NOT first_head_equal THEN '{K.REASON_FULL_EARLY}' ELSE {corrupt} END"
        judged = f"""
judged AS (SELECT s.*, d.dest_order, d.dest_id, d.root_path,
    CASE WHEN equal_path IS NOT NULL THEN 'Verified' WHEN same_path_path IS NOT NULL THEN 'Corrupt'
         ELSE 'Missing' END AS status,
    coalesce(equal_path, same_path_path) AS matched_path,
    CASE WHEN equal_path IS NOT NULL THEN NULL WHEN same_path_path IS NOT NULL THEN {corrupt}
         WHEN n IS NULL THEN '{K.REASON_NO_SIZE}' ELSE '{_MISSING[mode]}' END AS failure_reason
  FROM src s CROSS JOIN dests d LEFT JOIN best b ON b.source_path = s.full_path AND b.dest_id = d.dest_id),"""
    full_shown = shown["full_fp"]
    if mode == "Full":
        full_shown = "CASE WHEN r.head_fp = j.head_fp AND r.tail_fp = j.tail_fp THEN r.full_fp END"
    source_fps = ", ".join(
        f"j.{f}" if f in _SHOWN[mode] else f"NULL::VARCHAR AS {f}" for f in ["head_fp", "tail_fp", "deep_fp", "full_fp"]
    )
    tail = f"""
matches AS (SELECT j.relative_path, j.full_path, j.file_length, j.category, j.path_key, {source_fps},
    j.dest_order, j.dest_id, j.root_path, j.status, j.matched_path, j.failure_reason,
    {shown['head_fp']} AS dest_head_fp, {shown['tail_fp']} AS dest_tail_fp, {shown['deep_fp']} AS dest_deep_fp,
    {full_shown} AS dest_full_fp
  FROM judged j LEFT JOIN fp r ON r.full_path = j.matched_path AND r.root_id = j.dest_id),
file_status AS (SELECT full_path, any_value(relative_path) AS relative_path, any_value(file_length) AS file_length,
    any_value(category) AS category, any_value(path_key) AS path_key, any_value(head_fp) AS head_fp,
    any_value(tail_fp) AS tail_fp, any_value(deep_fp) AS deep_fp, any_value(full_fp) AS full_fp,
    CASE WHEN bool_or(status = 'Corrupt') THEN 'Corrupt' WHEN bool_and(status = 'Verified') THEN 'Verified'
         WHEN bool_or(status = 'Verified') THEN 'Partial' ELSE 'Missing' END AS overall_status
  FROM matches GROUP BY full_path)"""
    return common + judged + tail


def _summary(mode: str) -> str:
    return f"""WITH {match_ctes(mode)},
counts AS (SELECT count(*) AS total_files, CAST(coalesce(sum(file_length), 0) AS BIGINT) AS total_bytes,
    count(*) FILTER (overall_status = 'Verified') AS fully_verified_files,
    count(*) FILTER (overall_status = 'Partial') AS partially_verified_files,
    count(*) FILTER (overall_status = 'Missing') AS missing_files,
    count(*) FILTER (overall_status = 'Corrupt') AS corrupt_files FROM file_status)
SELECT '{trees.CARD_ROOT}' AS source_path, '{mode}' AS mode, *,
  CASE WHEN total_files = 0 THEN 'NoMediaFound' WHEN corrupt_files > 0 OR missing_files > 0 THEN 'UnsafeToFormat'
       WHEN partially_verified_files > 0 THEN 'PartiallyBackedUp' ELSE 'SafeToFormat' END AS safety_status
FROM counts"""


_MATCH_COLUMNS = (
    "relative_path, file_length, category, dest_id, status, matched_path, failure_reason, dest_head_fp, dest_tail_fp, "
    "dest_deep_fp, dest_full_fp"
)

_STAGE = {
    "SuperFast": [],
    "Quick": ["head_fp", "tail_fp"],
    "Deep": ["head_fp", "tail_fp", "deep_fp"],
    "Full": ["head_fp", "tail_fp", "full_fp"],
}
_GROUP = {
    "SuperFast": ["file_length", "category"],
    "Quick": ["file_length", "head_fp", "tail_fp"],
    "Deep": ["file_length", "deep_fp"],
    "Full": ["file_length", "full_fp"],
}
_KEY = {
    "SuperFast": "'meta_' || file_length || '_' || category",
    "Quick": f"{_HEX.format('head_fp')} || '_' || {_HEX.format('tail_fp')}",
    "Deep": _HEX.format("deep_fp"),
    "Full": _HEX.format("full_fp"),
}


def duplicate_ctes(mode: str) -> str:
    """``members``: one row per file of a group; ``groups``: one row per group."""
    base = TREES + ",\nfp AS (SELECT * FROM inv)" if mode == "SuperFast" else FINGERPRINTED
    stages = f"""{base},
src AS (SELECT * FROM fp WHERE root_id = 'card'),
dst AS (SELECT *, CASE root_id WHEN 'ssd' THEN 0 ELSE 1 END AS dest_order,
    count(*) OVER (PARTITION BY file_length, category) AS bucket_size FROM fp WHERE root_id <> 'card'),
stage1 AS (SELECT * FROM dst WHERE bucket_size > 1
  AND (file_length, category) IN (SELECT (file_length, category) FROM src)),
src1 AS (SELECT * FROM src WHERE (file_length, category) IN (SELECT (file_length, category) FROM stage1))"""
    last = "stage1"
    if mode != "SuperFast":
        stages += """,
stage2 AS (SELECT *, count(*) OVER (PARTITION BY file_length, head_fp, tail_fp) AS edge_size FROM stage1
  WHERE (file_length, category, head_fp, tail_fp) IN (SELECT (file_length, category, head_fp, tail_fp) FROM src1))"""
        last = "stage2"
    if mode in ("Deep", "Full"):
        fp = "deep_fp" if mode == "Deep" else "full_fp"
        stages += f""",
stage3 AS (SELECT * FROM stage2 WHERE edge_size > 1
  AND (file_length, {fp}) IN (SELECT (file_length, {fp}) FROM src1))"""
        last = "stage3"
    keys = ", ".join(_GROUP[mode])
    return f"""{stages},
members AS (SELECT *, {_KEY[mode]} AS group_key, file_length AS file_size,
    count(*) OVER (PARTITION BY {keys}) AS group_files,
    count(*) OVER (PARTITION BY {keys}, root_id) AS copies_here,
    row_number() OVER (PARTITION BY {keys}, root_id ORDER BY path_key, relative_path) AS position,
    row_number() OVER (PARTITION BY {keys} ORDER BY dest_order, path_key, relative_path) AS group_position
  FROM {last} QUALIFY group_files > 1),
groups AS (SELECT group_key, file_size, count(*) AS files, count(DISTINCT root_id) AS destinations,
    count(*) - count(DISTINCT root_id) AS redundant_copies,
    CAST((count(*) - count(DISTINCT root_id)) * file_size AS BIGINT) AS reclaimable_bytes,
    bool_or(copies_here > 1) AS is_intra, count(DISTINCT root_id) > 1 AS is_cross,
    max(CASE WHEN group_position = 1 THEN full_path END) AS first_path
  FROM members GROUP BY group_key, file_size{', category' if mode == 'SuperFast' else ''})"""


def sql() -> dict[str, str]:
    from . import oracle_io

    q: dict[str, str] = oracle_io.sql()
    q["inventory_by_category"] = f"""WITH {TREES} SELECT root_id, category, count(*) AS files,
  CAST(sum(file_length) AS BIGINT) AS bytes FROM inv GROUP BY ALL"""
    q["inventory_totals"] = f"""WITH {TREES} SELECT root_id, count(*) AS total_files,
  CAST(sum(file_length) AS BIGINT) AS total_bytes FROM inv GROUP BY ALL"""
    q["inventory_totals_all"] = q["inventory_totals"] + " UNION ALL SELECT 'tape', 0, 0"
    q["fingerprint_head_tail"] = f"""WITH {FINGERPRINTED}
SELECT root_id, relative_path, file_length, head_fp, tail_fp FROM fp"""
    q["fingerprint_full"] = f"""WITH {FINGERPRINTED}
SELECT root_id, relative_path, file_length, full_fp, {_HEX.format('full_fp')} AS full_hash FROM fp"""
    q["fingerprint_deep"] = f"WITH {FINGERPRINTED} SELECT root_id, relative_path, file_length, deep_fp FROM fp"
    q["probe_plan"] = f"""WITH {TREES}, {PROBE}
SELECT relative_path, file_length, unnest(plan).o AS slice_offset, unnest(plan).n AS slice_length
FROM probe8 JOIN inv USING (root_id, full_path, file_length) WHERE root_id = 'card'"""
    q["probe_plan_media"] = _probe_media()
    q["size_prune"] = f"""WITH {TREES}
SELECT root_id, relative_path, file_length FROM inv WHERE
  (root_id = 'card' AND file_length IN (SELECT file_length FROM inv WHERE root_id <> 'card'))
  OR (root_id <> 'card' AND file_length IN (SELECT file_length FROM inv WHERE root_id = 'card'))"""
    for mode in K.MODES:
        low = mode.lower()
        q[f"match_{low}"] = f"WITH {match_ctes(mode)} SELECT {_MATCH_COLUMNS} FROM matches"
        q[f"verify_summary_{low}"] = _summary(mode)
        q[f"dup_groups_{low}"] = f"""WITH {duplicate_ctes(mode)}
SELECT group_key, file_size, files, destinations, redundant_copies, reclaimable_bytes, is_intra, is_cross, first_path
FROM groups"""
        q[f"dup_totals_{low}"] = f"""WITH {duplicate_ctes(mode)}
SELECT count(*) AS groups, CAST(coalesce(sum(redundant_copies), 0) AS BIGINT) AS duplicate_copies,
  CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS reclaimable_bytes,
  count(*) FILTER (is_cross) AS cross_destination_groups FROM groups"""
    q["match_reasons"] = f"""WITH {match_ctes('Full')}
SELECT dest_id, status, coalesce(failure_reason, '') AS failure_reason, count(*) AS files FROM matches GROUP BY ALL"""
    q["match_enabled"] = f"""WITH {match_ctes('Quick')}
SELECT dest_id, status, count(*) AS files FROM matches GROUP BY ALL
UNION ALL SELECT 'tape', 'Missing', count(*) FROM inv WHERE root_id = 'card' HAVING count(*) > 0"""
    q["file_overall_status"] = f"""WITH {match_ctes('Quick')}
SELECT relative_path, file_length, category, overall_status FROM file_status"""
    q["file_overall_status_long"] = q["file_overall_status"].replace(
        "SELECT relative_path, file_length, category, overall_status", "SELECT relative_path, overall_status"
    )
    q["status_by_destination"] = f"""WITH {match_ctes('Full')}
SELECT dest_order, dest_id, CASE WHEN trim(root_path) = '' THEN dest_id ELSE root_path END AS label,
  count(*) FILTER (status = 'Verified') AS verified, count(*) FILTER (status = 'Missing') AS missing,
  count(*) FILTER (status = 'Corrupt') AS corrupt FROM matches GROUP BY dest_order, dest_id, root_path"""
    q["destination_labels"] = f"""WITH {match_ctes('Quick')}
SELECT dest_id, min(dest_order) AS dest_order,
  any_value(CASE WHEN trim(root_path) = '' THEN dest_id ELSE root_path END) AS label FROM matches GROUP BY dest_id"""
    q["hash_comparison"] = _comparison("Full")
    q["hash_comparison_deep"] = _comparison("Deep")
    q["unprotected_files"] = f"""WITH {match_ctes('Quick')}
SELECT relative_path, file_length, overall_status FROM file_status WHERE overall_status <> 'Verified'"""
    q["result_filter"] = f"""WITH {match_ctes('Full')}
SELECT relative_path, overall_status FROM file_status WHERE overall_status = 'Corrupt'
  AND contains(upper(relative_path), upper('src1'))"""
    q["dup_items_quick"] = f"""WITH {duplicate_ctes('Quick')}
SELECT group_key, file_size, root_id AS dest_id,
  CASE root_id WHEN 'ssd' THEN 'Field SSD' ELSE 'Studio NAS' END AS dest_name, relative_path,
  position = 1 AS is_primary, copies_here > 1 AS is_same_destination_duplicate,
  CASE WHEN copies_here = 1 THEN 'BACKUP COPY' WHEN position = 1 THEN 'PRIMARY' ELSE 'DUPLICATE' END AS badge
FROM members"""
    q["dup_top_k"] = f"""WITH {duplicate_ctes('Full')}
SELECT group_key, file_size, reclaimable_bytes FROM groups
ORDER BY reclaimable_bytes DESC, file_size DESC, group_key LIMIT 20"""
    q["dup_filter"] = f"""WITH {duplicate_ctes('Full')}
SELECT group_key, file_size, files FROM groups g WHERE is_intra AND EXISTS (
  SELECT 1 FROM members m WHERE m.group_key = g.group_key AND m.file_size = g.file_size
  AND (contains(upper(m.relative_path), upper('src1')) OR contains(upper(m.full_path), upper('src1'))))"""
    q["dup_group_texts"] = f"""WITH {duplicate_ctes('Full')}
SELECT group_key, regexp_extract(first_path, '[^/]*$') AS file_name,
  upper(regexp_extract(first_path, '\\.[^.]*$')) AS extension,
  {_report_size('file_size')} AS size_text, {_report_size('reclaimable_bytes')} AS reclaimable_text,
  CASE WHEN is_intra AND is_cross THEN 'SAME-DRIVE WASTE & MULTI-DRIVE'
       WHEN is_intra THEN 'SAME-DRIVE DUPLICATE WASTE' ELSE 'MULTI-DRIVE REDUNDANCY' END AS badge,
  CASE WHEN is_intra AND is_cross THEN 'Same-Drive and Multi-Drive'
       WHEN is_intra THEN 'Same-Drive Duplicate' ELSE 'Multi-Drive Redundant' END AS redundancy_type
FROM groups"""
    plan_columns = "dest_id, relative_path, file_length, action, target_path, error"
    q["copy_plan"] = f"WITH RECURSIVE {copy_ctes(False)} SELECT {plan_columns} FROM plan"
    q["copy_plan_distinct_roots"] = q["copy_plan"]
    q["copy_plan_unprotected"] = f"WITH RECURSIVE {copy_ctes(True)} SELECT {plan_columns} FROM plan"
    q["copy_sibling_lookup"] = f"""WITH RECURSIVE {copy_ctes(False)}
SELECT dest_id, relative_path FROM plan WHERE action = 'SKIP_SIBLING'"""
    q["copy_result_counts"] = f"""WITH RECURSIVE {copy_ctes(False)},
f AS (SELECT full_path, bool_or(action = 'NO_SPACE') AS failed, bool_or(action LIKE 'WRITE%') AS written,
  count(*) FILTER (action = 'WRITE_RENAMED') AS renamed FROM plan GROUP BY full_path)
SELECT count(*) FILTER (NOT failed AND written) AS copied_files, count(*) FILTER (NOT failed AND NOT written)
  AS skipped_files, count(*) FILTER (failed) AS failed_files, CAST(sum(renamed) AS BIGINT) AS renamed_copies FROM f"""
    q["copy_failures_by_destination"] = f"""WITH RECURSIVE {copy_ctes(False)}
SELECT dest_id, count(*) AS failures FROM plan WHERE action = 'NO_SPACE' GROUP BY dest_id"""
    q["verify_copies"] = f"""WITH RECURSIVE {copy_ctes(False)}
SELECT p.dest_id, p.relative_path, CASE WHEN h.full_path IS NULL THEN 'absent'
  WHEN h.file_length <> p.file_length THEN 'size differs'
  WHEN h.head_fp <> s.head_fp OR h.tail_fp <> s.tail_fp THEN 'checksum differs' ELSE 'verified' END AS outcome
FROM plan p JOIN src s USING (full_path)
LEFT JOIN held h ON h.root_id = p.dest_id AND h.relative_path = p.relative_path WHERE p.action LIKE 'WRITE%'"""
    q["capacity_check"] = f"""WITH {match_ctes('Full')},
need AS (SELECT CAST(sum(file_length) AS BIGINT) AS b FROM file_status WHERE overall_status <> 'Verified'),
spaces AS (SELECT * FROM (VALUES ('ssd', CAST({trees.SSD.free_bytes} AS BIGINT)),
  ('nas', CAST({trees.NAS.free_bytes} AS BIGINT))) v(dest_id, free_bytes))
SELECT dest_id, b AS required_bytes, free_bytes, b > free_bytes AS has_warning,
  CASE WHEN b > free_bytes THEN 'Insufficient space: needs ' || {_capacity('b')} || ', only '
    || {_capacity('free_bytes')} || ' free' ELSE '' END AS warning FROM need, spaces"""
    q["protection"] = f"""WITH s AS ({_summary('Full')})
SELECT safety_status, (fully_verified_files + partially_verified_files) / total_files * 100.0 AS backup_percentage,
  missing_files + corrupt_files AS unprotected,
  missing_files + partially_verified_files + corrupt_files AS unprotected_files,
  'UNSAFE TO FORMAT - ' || printf('%.0f', round((fully_verified_files + partially_verified_files) / total_files * 100.0))
    || '% BACKED UP (' || (missing_files + corrupt_files) || ' UNPROTECTED)' AS banner,
  'UNSAFE TO FORMAT - ' || format('{{:,}}', missing_files) || ' MISSING, ' || format('{{:,}}', corrupt_files)
    || ' CORRUPT' AS badge,
  'firebrick' AS colour, 'Full' AS mode_label FROM s"""
    return q


def copy_ctes(only_unprotected: bool, ssd_free: int = trees.SSD.free_bytes, only_nas: bool = False) -> str:
    """``plan``: the copy plan, with the space rule walked file by file.

    No card file asks for the numbered name of another, so names only depend on what the destinations hold.
    """
    only_unprotected = only_unprotected or only_nas
    base = match_ctes("Quick") if only_unprotected else FINGERPRINTED + ",\nsrc AS (SELECT * FROM fp WHERE root_id = 'card')"
    files = "SELECT s.* FROM src s JOIN file_status f USING (full_path) WHERE f.overall_status <> 'Verified'"
    if not only_unprotected:
        files = "SELECT * FROM src"
    if only_nas:
        files = "SELECT s.* FROM src s JOIN matches m USING (full_path) WHERE m.dest_id = 'nas' AND m.status <> 'Verified'"
    destinations = f"('nas', CAST({trees.NAS.free_bytes} AS BIGINT))"
    if not only_nas:
        destinations = f"('ssd', CAST({ssd_free} AS BIGINT)), {destinations}"
    stem = "regexp_replace(relative_path, '\\.[^./]*$', '')"
    ext = "regexp_extract(relative_path, '\\.[^./]*$')"
    return f"""{base},
wanted AS (SELECT f.*, d.dest_id, d.free FROM ({files}) f CROSS JOIN
  (VALUES {destinations}) d(dest_id, free)),
held AS (SELECT *, regexp_extract(relative_path, '_([0-9]+)(\\.[^./]*)?$', 1) AS digits,
  regexp_replace(relative_path, '_[0-9]+(\\.[^./]*)?$', '\\1') AS sibling_of FROM fp WHERE root_id <> 'card'),
judged_copy AS (SELECT w.dest_id, w.relative_path, w.full_path, w.path_key, w.file_length, w.free,
    h.full_path IS NOT NULL AS occupied,
    CASE WHEN h.file_length = w.file_length AND h.head_fp = w.head_fp AND h.tail_fp = w.tail_fp THEN 'SKIP_PATH'
         WHEN h.full_path IS NOT NULL AND EXISTS (SELECT 1 FROM held x WHERE x.root_id = w.dest_id AND x.digits <> ''
           AND upper(x.sibling_of) = upper(w.relative_path) AND x.file_length = w.file_length
           AND x.head_fp = w.head_fp AND x.tail_fp = w.tail_fp) THEN 'SKIP_SIBLING' END AS skip
  FROM wanted w LEFT JOIN held h ON h.root_id = w.dest_id AND h.relative_path = w.relative_path),
todo AS (SELECT *, row_number() OVER (PARTITION BY dest_id ORDER BY path_key, relative_path) AS rn
  FROM judged_copy WHERE skip IS NULL),
walk AS (
  SELECT dest_id, CAST(0 AS BIGINT) AS rn, free AS remaining, FALSE AS is_full, FALSE AS fits
    FROM (SELECT DISTINCT dest_id, free FROM todo)
  UNION ALL
  SELECT t.dest_id, t.rn,
    CASE WHEN CASE WHEN w.is_full THEN t.file_length < w.remaining ELSE t.file_length <= w.remaining END
         THEN w.remaining - t.file_length ELSE w.remaining END,
    w.is_full OR t.file_length > w.remaining,
    CASE WHEN w.is_full THEN t.file_length < w.remaining ELSE t.file_length <= w.remaining END
  FROM walk w JOIN todo t ON t.dest_id = w.dest_id AND t.rn = w.rn + 1),
numbers AS (SELECT t.dest_id, t.relative_path, min(n) AS n FROM
  (SELECT dest_id, relative_path, unnest(range(1, 2 + (SELECT count(*) FROM held x
     WHERE x.root_id = todo.dest_id AND x.sibling_of = todo.relative_path AND x.digits <> ''))) AS n
   FROM todo WHERE occupied) t
  WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.root_id = t.dest_id
    AND x.sibling_of = t.relative_path AND x.digits = CAST(t.n AS VARCHAR)) GROUP BY ALL),
decided AS (SELECT j.*, n.n, coalesce(j.skip, CASE WHEN NOT w.fits THEN 'NO_SPACE' WHEN j.occupied THEN 'WRITE_RENAMED'
    ELSE 'WRITE' END) AS action
  FROM judged_copy j LEFT JOIN todo t USING (dest_id, relative_path)
  LEFT JOIN walk w ON w.dest_id = t.dest_id AND w.rn = t.rn
  LEFT JOIN numbers n ON n.dest_id = j.dest_id AND n.relative_path = j.relative_path),
plan AS (SELECT dest_id, relative_path, full_path, file_length, action,
    CASE action WHEN 'WRITE' THEN relative_path WHEN 'WRITE_RENAMED' THEN {stem} || '_' || n || {ext} END AS target_path,
    CASE WHEN action = 'NO_SPACE' THEN '{K.COPY_FULL_MESSAGE}' END AS error FROM decided)"""


def _fixed(value, unit, decimals, suffix):
    return f"printf('%.{decimals}f {suffix}', round({value} / {float(unit)}, {decimals}))"


def _report_size(v):
    return (
        f"CASE WHEN {v} >= {K.GIB} THEN {_fixed(v, K.GIB, 2, 'GB')} WHEN {v} >= {K.MIB} THEN {_fixed(v, K.MIB, 1, 'MB')} "
        f"WHEN {v} >= {K.KIB} THEN {_fixed(v, K.KIB, 0, 'KB')} ELSE {v} || ' B' END"
    )


def _capacity(v):
    return (
        f"CASE WHEN {v} >= {K.TIB} THEN {_fixed(v, K.TIB, 1, 'TB')} WHEN {v} >= {K.GIB} THEN {_fixed(v, K.GIB, 1, 'GB')} "
        f"WHEN {v} >= {K.MIB} THEN {_fixed(v, K.MIB, 1, 'MB')} WHEN {v} >= {K.KIB} THEN {_fixed(v, K.KIB, 0, 'KB')} "
        f"ELSE {v} || ' B' END"
    )


def _comparison(mode):
    kinds = [(0, "Head", "head_fp"), (1, "Tail", "tail_fp"), (2, "Deep", "deep_fp"), (3, "Full", "full_fp")]
    parts = " UNION ALL ".join(
        f"SELECT relative_path, dest_id, status, {n} AS o, '{kind}' AS kind, {f} AS s, dest_{f} AS d FROM matches"
        for n, kind, f in kinds
    )
    return f"""WITH {match_ctes(mode)}, k AS ({parts})
SELECT relative_path, dest_id, kind, CASE WHEN s IS NULL THEN 'None' ELSE {_HEX.format('s')} END AS source_hash,
  CASE WHEN d IS NOT NULL THEN {_HEX.format('d')} WHEN status = 'Missing' THEN 'Missing' ELSE 'None' END AS dest_hash,
  CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN CASE WHEN s = d THEN 'MATCH' ELSE 'MISMATCH' END
       WHEN status = 'Missing' THEN 'MISSING' WHEN s IS NULL AND d IS NULL THEN '-' ELSE 'UNAVAILABLE' END AS comparison
FROM k WHERE o < 2 OR s IS NOT NULL OR d IS NOT NULL"""


def _probe_media():
    """Plan totals of orders read as media files: total price in units of 1000 bytes as the file length."""
    from ..functions.fingerprints import ProbeTiers

    chain = _probe(ProbeTiers()).rsplit(",\ndeep AS", 1)[0]
    return f"""WITH inv AS (SELECT o_orderkey AS full_path, 'orders' AS root_id, NULL::BLOB AS content,
  CAST(floor(o_totalprice * 1000) AS BIGINT) AS file_length FROM orders), {chain}
SELECT full_path AS o_orderkey, file_length, len(plan) AS slices,
  CAST(list_sum(list_transform(plan, lambda p: p.n)) AS BIGINT) AS bytes_read,
  CAST(list_sum(list_transform(plan, lambda p: p.o)) AS BIGINT) AS offset_sum FROM probe8"""
