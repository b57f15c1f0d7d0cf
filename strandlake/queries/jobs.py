"""The runnable jobs as queries: each runs its job twice into a new folder and returns the output read back."""

from __future__ import annotations

from jobs import mutation_profiles, running_rates
from strandlake.sources.scratch import scratch_path

QUERIES, SQL = {}, {}


def job1_mutation_profiles(spark, sf):
    """Mutation profiles of documents; the second run replaces what the first has written."""
    out = scratch_path(spark, "job1")
    for _ in range(2):
        mutation_profiles.run(spark, f"{sf}/documents.parquet", out)
    return mutation_profiles.read_output(spark, out)


def job2_running_rates(spark, sf):
    """Rates of events; the second run, with the first one's checkpoint, finds nothing new."""
    out = scratch_path(spark, "job2")
    for _ in range(2):
        # a pattern that fits the table alone: file streams take a folder or a pattern, and the table may be a single file
        running_rates.run(spark, f"{sf}/event[s].parquet", f"{out}/tables", f"{out}/checkpoint")
    return running_rates.read_output(spark, f"{out}/tables")


QUERIES["job1_mutation_profiles"] = job1_mutation_profiles
QUERIES["job2_running_rates"] = job2_running_rates

SQL["job1_mutation_profiles"] = """
WITH bases AS (
  SELECT cast(doc_id AS VARCHAR) AS read_id, coalesce(nullif(source, ''), 'none') AS sample, coalesce(nullif(lang, ''), 'none') AS gene,
    upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS s, row_number() OVER () AS r
  FROM documents),
pieces AS (SELECT *, unnest(range(0, (length(s) + 199) // 200)) AS piece FROM bases WHERE s <> ''),
reads AS (SELECT r, read_id, sample, gene, piece, substr(s, piece * 200 + 1, 200) AS seq FROM pieces),
long_reads AS (SELECT *, length(seq) AS length FROM reads WHERE length(seq) >= 160),
cells AS (
  SELECT r, read_id, sample, gene, piece, length, cast(unnest(range(0, length)) AS BIGINT) AS pos, unnest(string_split(seq, '')) AS base FROM long_reads),
consensus AS (
  SELECT gene, pos, base AS ref FROM (SELECT gene, pos, base, count(*) AS n FROM cells GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY gene, pos ORDER BY n DESC, base) = 1),
widths AS (SELECT gene, max(pos) + 1 AS width FROM consensus GROUP BY gene),
bits AS (SELECT c.*, CASE WHEN c.base = k.ref THEN '0' ELSE c.base END AS bit, k.ref FROM cells c JOIN consensus k ON c.gene = k.gene AND c.pos = k.pos),
library AS (
  SELECT b.r, b.read_id, b.sample, b.gene, b.piece, string_agg(bit, '' ORDER BY pos) || repeat('.', cast(any_value(width) - any_value(b.length) AS INT)) AS bits,
    cast(count(*) FILTER (bit <> '0') AS BIGINT) AS n_mut, count(*) FILTER (bit <> '0') / any_value(b.length) AS rate
  FROM bits b JOIN widths w ON b.gene = w.gene GROUP BY b.r, b.read_id, b.sample, b.gene, b.piece),
kept AS (SELECT *, rate > 0 AND rate < 0.7 AS kept FROM library),
covered AS (
  SELECT b.sample, b.gene, b.pos, any_value(b.ref) AS base, count(*) AS n, count(*) FILTER (b.bit <> '0') AS m
  FROM bits b JOIN kept k ON b.r = k.r AND b.piece = k.piece WHERE k.kept GROUP BY b.sample, b.gene, b.pos),
spine AS (SELECT DISTINCT k.sample, k.gene, p.pos, p.ref FROM kept k JOIN consensus p ON k.gene = p.gene WHERE k.kept)
SELECT 'library' AS kind, sample, gene, read_id, cast(piece AS BIGINT) AS piece, bits, n_mut, rate, kept, cast(NULL AS BIGINT) AS pos, cast(NULL AS VARCHAR) AS base,
  cast(NULL AS BIGINT) AS covered, cast(NULL AS BIGINT) AS informative, cast(NULL AS BIGINT) AS mismatches, cast(NULL AS BIGINT) AS n_reads FROM kept
UNION ALL
SELECT 'profile', s.sample, s.gene, NULL, NULL, NULL, NULL, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE m / n END, NULL, s.pos, s.ref, coalesce(n, 0), coalesce(n, 0), coalesce(m, 0), NULL
FROM spine s LEFT JOIN covered c ON s.sample = c.sample AND s.gene = c.gene AND s.pos = c.pos
UNION ALL
SELECT 'histogram', sample, gene, NULL, NULL, NULL, n_mut, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM kept GROUP BY sample, gene, n_mut"""

SQL["job2_running_rates"] = """
SELECT day, gene, pos, covered, informative, mods, CASE WHEN informative > 0 THEN mods / informative END AS rate FROM (
  SELECT coalesce(cast(cast(ts AS DATE) AS VARCHAR), 'none') AS day, coalesce(nullif(event_type, ''), 'none') AS gene, user_id AS pos, count(*) AS covered,
    cast(count(*) FILTER (value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL) AS BIGINT) AS informative,
    cast(count(*) FILTER (value > 20 AND NOT isnan(value) AND user_id IS NOT NULL) AS BIGINT) AS mods
  FROM events GROUP BY 1, 2, 3)"""
