"""SQL counterparts of :mod:`mirrorledger.plans.catalog_io`."""

from ..functions import constants as K
from . import oracle as o

_LABEL = "CASE WHEN trim(root_path) = '' THEN dest_id ELSE root_path END"


def _hex(f):
    return f"coalesce({o._HEX.format(f)}, '')"


def _html(v):
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")]:
        v = f"replace({v}, '{raw}', '{entity}')"
    return f"""list_aggregate(list_transform(string_split({v}, ''),
  lambda c: CASE WHEN unicode(c) BETWEEN 160 AND 255 THEN '&#' || unicode(c) || ';' ELSE c END), 'string_agg', '')"""


def _size_general(v):
    return (
        f"CASE WHEN {v} < 0 THEN '0 B' WHEN {v} >= {K.TIB} THEN {o._fixed(v, K.TIB, 2, 'TB')} "
        f"WHEN {v} >= {K.GIB} THEN {o._fixed(v, K.GIB, 2, 'GB')} WHEN {v} >= {K.MIB} THEN {o._fixed(v, K.MIB, 1, 'MB')} "
        f"WHEN {v} >= {K.KIB} THEN {o._fixed(v, K.KIB, 1, 'KB')} ELSE {v} || ' B' END"
    )


_GUARDED = "CASE WHEN left({0}, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {0} ELSE {0} END"


def _csv(v):
    return f"""'"' || replace({_GUARDED.format(v)}, '"', '""') || '"'"""


def _per_file(mode, extra=""):
    """``listed``: one row per card file with its destinations' statuses spread into columns."""
    return f"""{o.match_ctes(mode)},
spread AS (SELECT full_path,
    string_agg({_LABEL} || ':' || status, ';' ORDER BY dest_order) AS joined,
    max(CASE WHEN dest_id = 'ssd' THEN status END) AS ssd_status,
    max(CASE WHEN dest_id = 'nas' THEN status END) AS nas_status {extra}
  FROM matches GROUP BY full_path),
listed AS (SELECT f.*, s.* EXCLUDE (full_path) FROM file_status f JOIN spread s USING (full_path))"""


def _verdict_json(dest):
    def pick(column):
        return f"max(CASE WHEN dest_id = '{dest}' THEN {column} END)"

    hashes = ", ".join(
        f"'destination{name}Hash', {pick(o._HEX.format('dest_' + name.lower() + '_fp'))}"
        for name in ("Head", "Tail", "Deep", "Full")
    )
    return f"""json_object('destinationId', '{dest}', 'destinationRootPath', {pick('root_path')}, 'status', {pick('status')},
  'matchedFilePath', {pick('matched_path')}, 'failureReason', {pick('failure_reason')}, {hashes})"""


_EXIF = """
d AS (SELECT *, CASE lang WHEN 'en' THEN source || ' ' || lang ELSE 'Body ' || lang END AS model,
    octet_length(encode(text)) AS n_bytes, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_chars) AS taken FROM documents),
e AS (SELECT doc_id, source AS camera_make, model AS camera_model, 'lens ' || lang AS lens_model,
    strftime(taken, '%Y:%m:%d %H:%M:%S') AS date_time, n_chars || ' × ' || n_bytes AS dimensions,
    'ISO ' || least(n_chars, 65535) AS iso, CASE WHEN n_chars > 1 THEN '1/' || n_chars || 's' ELSE '1.0s' END AS exposure,
    printf('f/%.1f', (length(source) * 10 + 8) / 10.0::DOUBLE) AS f_number,
    printf('%.0fmm', round(n_chars / 10.0::DOUBLE)) AS focal_length,
    CASE lang WHEN 'en' THEN model ELSE source || ' ' || model END AS camera,
    strftime(taken, '%Y-%m-%d %H:%M:%S') AS captured_at, lang,
    226 + octet_length(encode(source)) + octet_length(encode(model)) + octet_length(encode('lens ' || lang)) + 3
      + n_bytes + CASE WHEN lang = 'en' THEN 0 ELSE 12 END AS file_length
  FROM d)"""

_WINDOWS = """
w AS (SELECT date_trunc('second', ts) - to_seconds(k) AS window_start, event_type AS device,
    CAST(sum(CAST(round(value * 1048576) AS BIGINT)) AS BIGINT) AS bytes
  FROM events, range(0, 5) r(k) GROUP BY ALL)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["inventory_files"] = f"""WITH {o.TREES}
SELECT root_id, relative_path, file_length, category FROM inv WHERE root_id IN ('card', 'nas')"""
    q["inventory_data_source"] = f"""WITH {o.TREES}
SELECT relative_path, file_length, category FROM inv WHERE root_id = 'card' AND ext <> '.iiq'"""
    q["fingerprint_files"] = f"""WITH {o.FINGERPRINTED}
SELECT relative_path, file_length, head_fp, tail_fp, deep_fp, full_fp, NULL::VARCHAR AS error FROM fp
WHERE root_id = 'card'"""
    q["staged_full_match"] = f"""WITH {o.match_ctes('Full')}
SELECT relative_path, dest_id, status, coalesce(failure_reason, '') AS reason FROM matches"""
    q["verify_files_cached"] = f"""WITH {o.match_ctes('Full')}
SELECT relative_path, dest_id, status, coalesce(failure_reason, '') AS reason, CAST(0 AS BIGINT) AS bytes_read FROM matches"""
    q["dup_files_staged"] = f"""WITH {o.duplicate_ctes('Full')}
SELECT group_key, file_size, files, destinations, redundant_copies, reclaimable_bytes, is_intra, is_cross FROM groups"""
    audited = o.duplicate_ctes("Quick").replace("src AS", "dup_src AS").replace("FROM src)", "FROM dup_src)").replace(
        "FROM src WHERE", "FROM dup_src WHERE"
    )
    shared = f"{o.FINGERPRINTED},"
    q["verify_files_audited"] = f"""WITH {o.match_ctes('Quick')}, {audited.removeprefix(shared)}
SELECT overall_status AS item, count(*) AS n FROM file_status GROUP BY overall_status
UNION ALL SELECT 'groups', count(*) FROM groups
UNION ALL SELECT 'duplicate_copies', CAST(coalesce(sum(redundant_copies), 0) AS BIGINT) FROM groups
UNION ALL SELECT 'reclaimable_bytes', CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) FROM groups
UNION ALL SELECT 'cross_destination_groups', count(*) FILTER (is_cross) FROM groups"""
    q["copy_execute"] = f"""WITH RECURSIVE {o.copy_ctes(True, ssd_free=10**15)},
f AS (SELECT full_path, bool_or(action LIKE 'WRITE%') AS written,
  count(*) FILTER (action = 'WRITE_RENAMED') AS renamed FROM plan GROUP BY full_path)
SELECT 'copied_files' AS item, count(*) FILTER (written) AS files FROM f
UNION ALL SELECT 'skipped_files', count(*) FILTER (NOT written) FROM f
UNION ALL SELECT 'failed_files', 0
UNION ALL SELECT 'renamed_copies', CAST(sum(renamed) AS BIGINT) FROM f
UNION ALL SELECT 'after: Verified', count(*) FROM src"""
    q["copy_check"] = f"""WITH RECURSIVE {o.copy_ctes(True, only_nas=True)}
SELECT relative_path, target_path, 'verified' AS outcome FROM plan WHERE action LIKE 'WRITE%'"""

    presets = " UNION ALL ".join(
        f"SELECT '{name}' AS preset, category, file_length FROM inv WHERE root_id = 'card' AND lower(ext) IN "
        f"({o._strings(extensions)})"
        for name, extensions in K.PRESETS.items()
    )
    q["preset_filter"] = f"""WITH {o.TREES}, p AS ({presets})
SELECT preset, category, count(*) AS files, CAST(sum(file_length) AS BIGINT) AS bytes FROM p GROUP BY ALL"""
    q["ignored_dirs"] = """SELECT CASE source WHEN 'src6' THEN 'Lightroom Catalogs/' WHEN 'src7' THEN 'DCIM/100EOS/'
  ELSE '' END || doc_id || CASE lang WHEN 'en' THEN '.JPG' ELSE '.Mov' END AS relative_path FROM documents
WHERE lang IN ('en', 'de') AND source NOT IN
  ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src8', 'src9', 'src10')"""
    q["path_parts"] = f"""WITH {o.TREES}
SELECT root_id, relative_path, regexp_extract(relative_path, '[^/]*$') AS name,
  regexp_replace(relative_path, '/?[^/]*$', '') AS folder,
  regexp_replace(regexp_extract(relative_path, '[^/]*$'), '\\.[^.]*$', '') AS stem, upper(ext) AS extension,
  CASE WHEN regexp_matches(relative_path, '_[0-9]+\\.[^./]*$')
       THEN regexp_replace(relative_path, '_[0-9]+(\\.[^./]*)$', '\\1') ELSE '' END AS sibling_of,
  relative_path AS relative,
  CASE category WHEN 'PhotoRaw' THEN 'RAW Photo' WHEN 'PhotoStandard' THEN 'Standard Photo' WHEN 'Video' THEN 'Video'
    WHEN 'Sidecar' THEN 'Metadata Sidecar' ELSE 'Other Media File' END AS category_label
FROM inv WHERE root_id <> 'card'"""
    q["byte_size_text"] = f"""WITH s AS (SELECT CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents UNION ALL
  SELECT CAST(trunc(o_totalprice * o_totalprice * 1000) AS BIGINT) - 5000 FROM orders)
SELECT size, {_size_general('size')} AS general, {o._report_size('size')} AS report, {o._capacity('size')} AS capacity,
  CASE WHEN size >= {K.MIB} THEN {o._fixed('size', K.MIB, 1, 'MB')} ELSE {o._fixed('size', K.KIB, 1, 'KB')} END AS item,
  {o._fixed('size', K.MIB, 2, 'MB')} AS certificate FROM s"""
    q["hash_text"] = """WITH g AS (SELECT doc_id, lang, n_chars, md5(encode(text)) AS m FROM documents)
SELECT doc_id, CASE lang WHEN 'en' THEN '0x' || upper(substr(m, 1, 16)) WHEN 'fr' THEN '0X' || substr(m, 1, 7)
    WHEN 'de' THEN CAST(n_chars * 1000003 AS VARCHAR) ELSE substr(m, 1, 16) END AS given,
  CASE lang WHEN 'en' THEN upper(substr(m, 1, 16)) WHEN 'fr' THEN lpad(upper(substr(m, 1, 7)), 16, '0')
    WHEN 'de' THEN printf('%016X', n_chars * 1000003)
    ELSE CASE WHEN regexp_full_match(substr(m, 1, 16), '[0-9]+') THEN printf('%016X', CAST(substr(m, 1, 16) AS BIGINT))
         ELSE 'rejected' END END AS parsed FROM g"""
    q["csv_text"] = f"""WITH g AS (SELECT doc_id, text,
  CASE lang WHEN 'en' THEN '=' WHEN 'fr' THEN '@' ELSE '' END || source AS s FROM documents)
SELECT doc_id, {_csv('text')} AS field, {_csv('s')} AS guarded FROM g"""
    q["html_text"] = f"SELECT page_id, {_html('html')} AS escaped FROM pages"
    q["path_overlap"] = f"""WITH p AS (SELECT doc_id, lang,
  '/Volume/' || source || CASE lang WHEN 'fr' THEN '/' ELSE '' END AS source_path,
  CASE lang WHEN 'fr' THEN '/volume/' || source WHEN 'de' THEN '/volume/' || source || '/backup' WHEN 'es' THEN '/volume'
    ELSE '/volume/' || source || 'x' END AS destination_path FROM documents)
SELECT doc_id, source_path, destination_path, lang NOT IN ('fr', 'de') AS is_valid,
  CASE lang WHEN 'fr' THEN '{K.OVERLAP_SAME_MESSAGE}' WHEN 'de' THEN '{K.OVERLAP_INSIDE_MESSAGE}' ELSE '' END
    AS validation_error FROM p"""
    mounts = """m AS (SELECT DISTINCT s_nationkey AS n FROM supplier),
old AS (SELECT n, '/mnt/ssd/' || CASE WHEN n % 5 = 0 THEN 'Earlier' ELSE 'Archive' END || '/src' || n AS path FROM m),
new AS (SELECT n, '/mnt/ssd/' || CASE WHEN n % 7 = 1 THEN 'Later' ELSE 'Archive' END || '/src' || n AS path FROM m),
ev AS (SELECT path, CASE WHEN n < 12 THEN 'Removable Drive' ELSE 'CARD' || n END AS label,
    n < 20 AS is_removable, 'Inserted' AS event_type FROM new WHERE path NOT IN (SELECT path FROM old)
  UNION ALL SELECT path, 'Ejected Drive', TRUE, 'Removed' FROM old WHERE path NOT IN (SELECT path FROM new))"""
    q["mount_diff"] = f"WITH {mounts} SELECT path, label, is_removable, event_type FROM ev"
    q["mount_affected"] = f"""WITH {o.TREES}, {mounts}
SELECT DISTINCT relative_path FROM inv WHERE root_id = 'ssd' AND EXISTS (SELECT 1 FROM ev
  WHERE upper(full_path) = upper(path) OR starts_with(upper(full_path), upper(path) || '/'))"""

    def csv_columns(mode):
        return f"""{_GUARDED.format('relative_path')} AS "RelativePath", file_length AS "FileSizeBytes",
  category AS "Category", overall_status AS "OverallStatus", {_hex('head_fp')} AS "HeadHash", {_hex('tail_fp')} AS "TailHash",
  {_hex('deep_fp')} AS "DeepHash", {_hex('full_fp')} AS "FullHash", {_GUARDED.format('joined')} AS "DestinationStatuses",
  ssd_status AS "/mnt/ssd", nas_status AS "nas" """

    q["report_csv_rows"] = f"WITH {_per_file('Quick')} SELECT {csv_columns('Quick')} FROM listed"
    q["report_csv_lines"] = f"""WITH {_per_file('Full')}
SELECT concat_ws(',', {_csv('relative_path')}, file_length, category, overall_status, {_hex('head_fp')}, {_hex('tail_fp')},
  {_hex('deep_fp')}, {_hex('full_fp')}, {_csv('joined')}, ssd_status, nas_status) AS line FROM listed"""
    q["report_csv_roundtrip"] = f"""WITH {_per_file('Quick')}
SELECT relative_path AS "RelativePath", overall_status AS "OverallStatus", {_hex('head_fp')} AS "HeadHash",
  joined AS "DestinationStatuses", nas_status AS "nas" FROM listed"""
    q["report_order"] = f"""WITH {o.TREES}
SELECT row_number() OVER (ORDER BY path_key, relative_path) AS position, relative_path AS "RelativePath" FROM inv
WHERE root_id = 'card'"""
    q["report_duplicate_rows"] = f"""WITH {o.duplicate_ctes('Full')}
SELECT CASE root_id WHEN 'ssd' THEN 'Field SSD' ELSE 'Studio NAS' END AS "Destination", relative_path AS "RelativePath",
  m.file_size AS "FileSizeBytes", CASE WHEN position = 1 THEN 'True' ELSE 'False' END AS "IsPrimary",
  m.group_key AS "GroupKey", reclaimable_bytes AS "ReclaimableGroupBytes",
  CASE WHEN is_intra AND is_cross THEN 'Same-Drive and Multi-Drive' WHEN is_intra THEN 'Same-Drive Duplicate'
       ELSE 'Multi-Drive Redundant' END AS "RedundancyType"
FROM members m JOIN groups g ON g.group_key = m.group_key AND g.file_size = m.file_size"""
    verdicts = f", {_verdict_json('ssd')} AS ssd_json, {_verdict_json('nas')} AS nas_json"
    hashes = ", ".join(f"'{n}Hash', {o._HEX.format(n + '_fp')}" for n in ("head", "tail", "deep", "full"))
    q["report_json_rows"] = f"""WITH {_per_file('Quick', verdicts)}
SELECT relative_path, CAST(json_object('sourceFile', json_object('relativePath', relative_path, 'fullPath', full_path,
    'fileLength', file_length, 'category', category, {hashes}),
  'destinationStatuses', json_object('ssd', ssd_json, 'nas', nas_json),
  'isFullyVerified', overall_status = 'Verified',
  'isPartiallyVerified', (ssd_status = 'Verified') <> (nas_status = 'Verified'),
  'isMissingFromAll', ssd_status = 'Missing' AND nas_status = 'Missing',
  'hasAnyCorruption', ssd_status = 'Corrupt' OR nas_status = 'Corrupt',
  'overallStatus', overall_status) AS VARCHAR) AS document FROM listed"""
    q["report_json_summary"] = f"""WITH s AS ({o._summary('Quick')})
SELECT CAST(json_object('sourcePath', source_path, 'mode', mode, 'totalFiles', total_files, 'totalBytes', total_bytes,
  'fullyVerifiedFiles', fully_verified_files, 'partiallyVerifiedFiles', partially_verified_files,
  'missingFiles', missing_files, 'corruptFiles', corrupt_files, 'safetyStatus', safety_status) AS VARCHAR) AS document
FROM s"""
    line = f"""'<li>' || status || ' on ' || {_html(_LABEL)} || '</li>'"""
    q["report_html_rows"] = f"""WITH {_per_file('Full', f", string_agg({line}, '' ORDER BY dest_order) AS lines")}
SELECT relative_path, '<tr><td>' || {_html('relative_path')} || '</td><td>' || {o._fixed('file_length', K.MIB, 2, 'MB')}
  || '</td><td>' || category || '</td><td><span class="badge '
  || CASE overall_status WHEN 'Verified' THEN 'badge-ok' WHEN 'Partial' THEN 'badge-warn' ELSE 'badge-err' END
  || '">' || overall_status || '</span></td><td><samp>'
  || {o._HEX.format('full_fp')} || '</samp></td><td><ul>' || lines || '</ul></td></tr>' AS fragment FROM listed"""
    groups = o.duplicate_ctes("Quick").replace("src AS", "dup_src AS").replace("FROM src)", "FROM dup_src)").replace(
        "FROM src WHERE", "FROM dup_src WHERE"
    )
    q["report_html_page"] = f"""WITH {groups}, n AS (SELECT (SELECT count(*) FROM members) AS members,
  (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM dup_src) AS files)
SELECT 'row' AS kind, files + groups + 2 AS lines FROM n UNION ALL SELECT 'location', members FROM n
UNION ALL SELECT 'frame', groups + 7 FROM n"""
    q["report_html_order"] = f"""WITH page AS ({q['report_html_rows']}),
listing AS (SELECT fragment, row_number() OVER (ORDER BY upper(relative_path), relative_path) AS position FROM page)
SELECT position, fragment AS line FROM listing"""
    summary = q["report_json_summary"]
    q["report_json_audit"] = f"""WITH {o.duplicate_ctes('Quick')}, d AS (SELECT CAST(coalesce(sum(redundant_copies), 0) AS BIGINT) AS copies,
  CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (is_cross) AS crossing FROM groups),
j AS ({summary})
SELECT '{{"timestampUtc":"2024-01-01T00:00:00Z",' || substr(document, 2, length(document) - 2) || ',"duration":"00:00:05","duplicateAnalysis":'
  || CAST(json_object('totalDuplicateCopies', copies, 'totalReclaimableBytes', bytes, 'crossDestinationRedundantFileCount', crossing)
    AS VARCHAR) || '}}' AS document FROM j, d"""
    q["report_json_duplicates"] = f"""WITH {o.duplicate_ctes('Full')}
SELECT m.group_key, root_id AS dest_id, relative_path, CAST(json_object('groupKey', m.group_key, 'fileSize', m.file_size,
    'reclaimableBytes', g.reclaimable_bytes, 'isIntraDestination', g.is_intra, 'isCrossDestination', g.is_cross,
    'file', json_object('destinationId', root_id, 'destinationName', CASE root_id WHEN 'ssd' THEN 'Field SSD' ELSE 'Studio NAS' END,
      'relativePath', relative_path, 'fullPath', full_path, 'isPrimary', position = 1,
      'isSameDestinationDuplicate', copies_here > 1 OR position > 1)) AS VARCHAR) AS document
FROM members m JOIN groups g ON g.group_key = m.group_key AND g.file_size = m.file_size"""
    q["report_best_checksum"] = f"""WITH {o.FINGERPRINTED}
SELECT relative_path, {o._HEX.format('deep_fp')} || ' (Deep)' AS checksum FROM fp WHERE root_id = 'card'"""

    q["cache_hits"] = f"""WITH {o.FINGERPRINTED}
SELECT relative_path, mtime IS NOT NULL AND category <> 'Video' AS is_hit,
  CASE WHEN mtime IS NOT NULL AND category <> 'Video' THEN head_fp ELSE '' END AS head_fp
FROM fp WHERE root_id = 'card'"""
    q["cache_upsert"] = f"""WITH {o.FINGERPRINTED}
SELECT full_path, file_length, CASE WHEN category <> 'Video' THEN head_fp ELSE '' END AS head_fp,
  CASE WHEN category <> 'Video' THEN tail_fp ELSE '' END AS tail_fp, '' AS deep_fp, full_fp
FROM fp WHERE root_id = 'card'"""
    q["cache_merge"] = q["cache_upsert"]
    q["cache_get"] = f"""WITH {o.FINGERPRINTED} SELECT full_path, file_length, head_fp FROM fp
WHERE root_id = 'card' AND category = 'PhotoStandard' ORDER BY full_path LIMIT 1"""
    q["cache_by_length"] = f"""WITH {o.FINGERPRINTED}
SELECT full_path, file_length, head_fp FROM fp WHERE root_id = 'card' AND file_length = 897"""
    q["cache_by_length_sorted"] = q["cache_by_length"]
    q["cache_compact_clear"] = f"""WITH {o.FINGERPRINTED}
SELECT 2 * count(*) AS versions, count(*) AS compacted, 0 AS after_clear FROM fp WHERE root_id = 'card'"""

    q["exif_metadata"] = f"""WITH {_EXIF}
SELECT doc_id, TRUE AS has_exif, camera_make, camera_model, lens_model, date_time, dimensions, iso, exposure, f_number,
  focal_length, camera, focal_length || ' • ' || f_number || ' • ' || exposure || ' • ' || iso AS exposure_summary,
  captured_at FROM e"""
    q["exif_thumbnail"] = """SELECT doc_id, octet_length(encode(text)) AS bytes, md5(encode(text)) AS thumbnail_md5
FROM documents"""
    q["exif_catalogue"] = f"""WITH {_EXIF}
SELECT camera, count(*) AS files, CAST(sum(file_length) AS BIGINT) AS bytes FROM e GROUP BY camera"""
    q["exif_by_category"] = f"""WITH {_EXIF}
SELECT CASE WHEN lang = 'en' THEN 'PhotoRaw' ELSE 'PhotoStandard' END AS category, count(*) AS files,
  CAST(sum(file_length) AS BIGINT) AS bytes FROM e GROUP BY ALL"""

    q["throughput_sliding"] = f"""WITH {_WINDOWS}
SELECT CAST(window_start AS VARCHAR) AS window_start, device, bytes, bytes / 5.0::DOUBLE AS bytes_per_second,
  round_even(bytes / 1048576.0::DOUBLE / 5, 1) AS mb_per_second FROM w"""
    q["throughput_stream_complete"] = q["throughput_sliding"]
    q["throughput_total"] = f"""WITH {_WINDOWS}
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(sum(bytes) AS BIGINT) AS bytes,
  sum(bytes) / 5.0::DOUBLE AS bytes_per_second FROM w GROUP BY window_start"""
    q["throughput_stream"] = f"""WITH {_WINDOWS}
SELECT CAST(window_start + to_seconds(5) AS VARCHAR) AS window_end, device, bytes, bytes / 5.0::DOUBLE AS bytes_per_second
FROM w WHERE window_start + to_seconds(5) <= (SELECT date_trunc('millisecond', max(ts)) - to_seconds(10) FROM events)"""
    q["stream_ingest"] = f"""WITH {o.FINGERPRINTED}
SELECT full_path, file_length, head_fp, tail_fp FROM fp WHERE root_id = 'card'"""
    q["stream_verify"] = f"""WITH {o.match_ctes('Quick')}
SELECT relative_path, dest_id, status, matched_path FROM matches"""
    return q
