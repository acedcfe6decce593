"""DuckDB equivalents of the queries that SQL can express on whole tables."""

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM rows JOIN grouped USING (t)
""",
}
