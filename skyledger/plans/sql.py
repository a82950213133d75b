"""SQL that the oracles share: the packets, the typed sources, and exact UTC days."""

PACKETS = """
WITH packets AS (
  SELECT event_id + 1 AS source_id,
    CASE WHEN user_id % 7 = 0 THEN 0 WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS raw_object_id,
    event_id % 5 = 0 AS is_sso,
    (epoch_us(ts) + 37000000) / 86400000000.0::DOUBLE + 40587 AS mjd_tai,
    ((event_id * 7919) % 360000) / 1000.0::DOUBLE AS ra,
    ((event_id * 104729) % 180001) / 1000.0::DOUBLE - 90 AS dec,
    CASE event_type WHEN 'view' THEN 'g' WHEN 'click' THEN 'r' WHEN 'purchase' THEN 'i' WHEN 'signup' THEN 'z' WHEN 'error' THEN 'y' END AS band,
    value AS flux, 1 + (event_id % 10) / 10.0::DOUBLE AS flux_err,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a1' ELSE 'a2' END AS acquisition_id
  FROM events),
sources AS (
  SELECT *, CASE WHEN NOT is_sso AND raw_object_id > 0 THEN 'DIA' WHEN is_sso AND (raw_object_id IS NULL OR raw_object_id = 0) THEN 'SSO' ELSE 'AMBIGUOUS' END AS population,
    CASE WHEN NOT is_sso AND raw_object_id > 0 THEN raw_object_id END AS object_id,
    11 + k % 3 AS cats_class, CASE WHEN k % 25 = 0 THEN 'nan'::DOUBLE ELSE k / 100.0::DOUBLE END AS cats_score,
    DATE '1858-11-17' + (CASE WHEN mjd_tai < floor(mjd_tai) + 37 / 86400.0::DOUBLE THEN floor(mjd_tai) - 1 ELSE floor(mjd_tai) END)::INTEGER AS utc_day,
    DATE '1858-11-17' + floor(mjd_tai)::INTEGER AS night
  FROM packets)
"""
ACQUISITIONS = ", acquisitions AS (SELECT * FROM (VALUES ('a1', DATE '2024-01-01', DATE '2024-01-16'), ('a2', DATE '2024-01-16', DATE '2024-02-03')) a(acquisition_id, start, stop))"


def over_packets(select: str) -> str:
    return PACKETS + select


def unpivoted(rows: str, columns: list[tuple[str, str]], source: str) -> str:
    """UNION ALL of one select a column: ``rows`` has {c} for its name and {x} for its expression."""
    return "\nUNION ALL ".join(f"SELECT {rows.format(c=c, x=x)} FROM {source}" for c, x in columns)
