"""SQL text of the model views, for the oracle side. Mirrors `plans/views.py`."""


def _words(turns: str) -> str:
    return f"""
turns AS ({turns}),
toks AS (SELECT project_slug, source_slug, turn, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos, len(t) AS n FROM turns),
idx AS (SELECT *, row_number() OVER (PARTITION BY project_slug, source_slug ORDER BY turn, pos) - 1 AS word_index FROM toks),
ms AS (SELECT *, 120 + 30 * length(word) AS dur,
  CASE WHEN pos = n - 1 THEN 2100 WHEN regexp_matches(word, '[.!?]$') THEN 400 + 100 * (pos % 4)
       WHEN word LIKE '%,' THEN 250 ELSE 40 END AS gap FROM idx),
timed AS (SELECT *, CAST(COALESCE(SUM(dur + gap) OVER (PARTITION BY project_slug, source_slug ORDER BY word_index
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t0 FROM ms),
words AS (SELECT project_slug, source_slug, word_index, word, t0 / 1000.0::DOUBLE AS start_time, (t0 + dur) / 1000.0::DOUBLE AS end_time,
  CASE WHEN word_index % 13 <> 0 THEN ((word_index * 37 + length(word) * 11) % 100) / 100.0::DOUBLE END AS confidence, turn FROM timed)"""


WORDS = _words(
    """SELECT 'p' || (conv_id % 5) AS project_slug, 'c' || conv_id AS source_slug, turn,
  list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM conversations"""
)
DOC_WORDS = _words(
    """SELECT lang AS project_slug, 'd' || doc_id AS source_slug, i - 1 AS turn,
  list_filter(regexp_split_to_array(l, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t
  FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""
)

UTTERANCES = """
gapped AS (SELECT *, start_time - lag(end_time) OVER w AS gap, lag(end_time) OVER w AS prev_end FROM words
  WINDOW w AS (PARTITION BY project_slug, source_slug ORDER BY word_index)),
runs AS (SELECT *, SUM(CASE WHEN gap IS NULL OR gap >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY project_slug, source_slug ORDER BY word_index) AS run FROM gapped),
utt AS (SELECT project_slug, source_slug, run, MIN(word_index) AS first_index, MAX(word_index) AS last_index, COUNT(*) AS n_words,
  arg_min(start_time, word_index) AS s, arg_max(end_time, word_index) AS e, string_agg(word, ' ' ORDER BY word_index) AS text
  FROM runs GROUP BY ALL)"""

DURATIONS = """
durations AS (SELECT project_slug, source_slug, MAX(end_time) AS duration_seconds FROM words GROUP BY ALL)"""

SEGMENTS = """
segments AS (SELECT l_orderkey AS spec_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS seg_index,
  'c' || l_suppkey AS source_id, l_quantity - 1.0::DOUBLE + (l_partkey % 8) / 1024.0::DOUBLE AS start, l_quantity + (l_partkey % 8) / 1024.0::DOUBLE + l_partkey % 20 + (l_linenumber % 4) / 1024.0::DOUBLE AS "end",
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE WHEN l_linenumber % 3 = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS speed,
  CASE WHEN l_returnflag = 'R' OR l_partkey % 5 = 0 THEN 'crossfade' END AS transition_type,
  CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE WHEN l_partkey % 5 = 0 THEN 1.5::DOUBLE END AS transition_duration,
  CASE WHEN l_discount < 0.02 THEN 0.0::DOUBLE WHEN l_tax > 0.06 THEN 0.5::DOUBLE END AS volume,
  CASE WHEN l_partkey % 11 = 0 THEN true WHEN l_partkey % 13 = 0 THEN false END AS audio_from_prev FROM lineitem)"""

OVERLAYS = """
laid AS (SELECT o_orderkey AS k, o_custkey AS c, unnest(range(0, o_custkey % 3 + 1)) AS i FROM orders),
overlays AS (SELECT k AS spec_id, i AS ov_index,
  CASE WHEN (k + i) % 4 <= 1 THEN 'c' || (c // 15 + i) END AS source_id,
  (c % 8 + i * 1.5::DOUBLE) AS start, (c % 8 + i * 1.5::DOUBLE) + 1.0::DOUBLE + (k % 6) * 0.5::DOUBLE AS "end",
  (k % 5) * 0.25::DOUBLE AS x, (c % 4) * 0.25::DOUBLE AS y, 0.5::DOUBLE AS width,
  CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS height,
  CASE WHEN k % 3 = 0 THEN 0.5::DOUBLE END AS opacity,
  CASE WHEN k % 4 > 0 THEN (k % 5)::DOUBLE END AS source_start,
  CASE WHEN c % 2 = 0 THEN 3 - i END AS z_index,
  CASE WHEN (k + i) % 4 = 3 AND k % 3 > 0 THEN '#1a1a2e' WHEN (k + i) % 4 = 3 THEN '#zz' END AS background_color,
  CASE WHEN (k + i) % 4 = 2 AND c % 2 = 0 THEN 'Title ' || c END AS title,
  CASE WHEN (k + i) % 4 = 2 AND c % 2 = 1 THEN '/img/card.png' END AS image_path,
  CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE END AS fade_in, CASE WHEN k % 3 = 1 THEN 0.25::DOUBLE END AS fade_out,
  CASE k % 7 WHEN 0 THEN 0.125::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 8.0::DOUBLE END AS speed FROM laid)"""

KEYFRAMES = """
keyframes AS (SELECT 'k' || user_id AS track_id, event_id AS keyframe_id, (floor(epoch(ts)) - 1704067200)::DOUBLE AS time,
  CASE WHEN event_type = 'click' THEN floor(value * 4) / 4.0::DOUBLE END AS scale,
  CASE WHEN event_type = 'view' THEN floor(value * 4) / 4.0::DOUBLE END AS opacity,
  CASE WHEN event_type = 'purchase' THEN floor(value * 4) / 4.0::DOUBLE END AS x,
  CASE WHEN event_type = 'signup' THEN floor(value * 4) / 4.0::DOUBLE END AS y,
  CASE WHEN event_type = 'error' THEN floor(value * 4) / 4.0::DOUBLE END AS rotation FROM events)"""

ASSETS = """
assets AS (SELECT 'p' || (p_size % 5) AS project_slug, 'a' || p_partkey AS slug, p_name || ' ' || p_partkey || '.MP4' AS filename,
  '/media/' || p_brand || '/' || p_name || ' ' || p_partkey || '.MP4' AS file_path, p_partkey * 1000 + p_size AS file_size_bytes,
  p_size * 1.5::DOUBLE AS duration_seconds,
  CASE WHEN p_partkey % 3 = 1 THEN sh ELSE lo END AS width, CASE WHEN p_partkey % 3 = 1 THEN lo ELSE sh END AS height,
  CASE p_partkey % 4 WHEN 0 THEN 29.97::DOUBLE WHEN 1 THEN 23.976::DOUBLE WHEN 2 THEN 60.0::DOUBLE ELSE 12.5::DOUBLE END AS fps,
  CASE WHEN p_partkey % 2 = 0 THEN 'hevc' ELSE 'h264' END AS codec, p_partkey % 5 <> 0 AS has_audio,
  '["' || lower(p_type) || '","' || lower(p_brand) || '"]' AS tags_json,
  make_timestamp((1704067200 + ((p_partkey * 7919) % 1000) * 60) * 1000000) AS created, p_partkey
  FROM (SELECT *, CASE p_type WHEN 'LARGE' THEN 3840 WHEN 'SMALL' THEN 1280 ELSE 1920 END AS lo,
    CASE p_type WHEN 'LARGE' THEN 2160 WHEN 'SMALL' THEN 720 WHEN 'PROMO' THEN 1440 ELSE 1080 END AS sh FROM part))"""

PROJECTS = """
projects AS (SELECT 'p' || c_custkey AS slug, c_name AS name, CASE WHEN c_custkey % 10 = 9 THEN 'archived' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS description,
  make_timestamp((1704067200 + c_custkey * 3600) * 1000000) AS created, make_timestamp((1704067200 + c_custkey * 3600) * 1000000) AS updated FROM customer)"""

RENDERS = """
renders AS (SELECT 'p' || o_custkey AS project_slug, 'r' || o_orderkey AS slug,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'draft' ELSE 'failed' END AS status,
  (o_orderkey % 480) / 8.0::DOUBLE AS duration_seconds, '/out/render ' || o_orderkey || '.mp4' AS output_path,
  ((o_orderkey * 7919) % 100000) * 1024 AS file_size_bytes,
  '["c' || (o_orderkey % 100) || '","c' || ((o_orderkey * 7) % 100) || '"]' AS sources_json, o_orderpriority AS notes_md, o_orderdate AS created FROM orders)"""

TELEMETRY = """
telemetry AS (SELECT 'u' || user_id || '/d' || day(ts) AS render_id, event_id AS seq, ts, event_type AS phase, floor(value * 4) / 4.0::DOUBLE AS seconds FROM events)"""

FRAMES = """
frames AS (SELECT 'u' || user_id AS render_id, event_id AS seq, (floor(epoch(ts)) - 1704067200)::DOUBLE AS recorded_at, floor(value * 4) / 4.0::DOUBLE AS elapsed FROM events)"""

USAGE = """
asked AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS asker, (floor(value / 2.0::DOUBLE) + 1) * 6.0::DOUBLE AS tenths FROM events),
usage AS (SELECT 'u' || asker AS uid, CASE WHEN asker % 3 = 0 THEN 'pro' ELSE 'free' END AS tier, event_id AS request_id, ts,
  CASE event_id % 97 WHEN 1 THEN NULL WHEN 2 THEN -tenths WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 'NaN'::DOUBLE ELSE tenths END AS duration_seconds FROM asked)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
