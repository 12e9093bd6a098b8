"""SQL that gives the same rows as the queries of this subpackage."""

SQL = {
    "p2_found": """
WITH once AS (
  SELECT *, row_number() OVER (PARTITION BY repo, scan_id, id ORDER BY finding_key) AS n FROM findings
), f AS (
  SELECT finding_key, repo, confidence,
    array_to_string(list_filter(string_split(replace(file_path, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS file,
    CASE lower(trim(severity)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END AS sev
  FROM once WHERE n = 1 AND file_path IS NOT NULL
), r AS (
  SELECT finding_key, row_number() OVER (PARTITION BY repo, file ORDER BY sev, confidence DESC NULLS LAST, finding_key) AS rank_no FROM f
)
SELECT finding_key, rank_no FROM r WHERE rank_no <= 3
""",
}
