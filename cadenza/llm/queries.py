"""The corpus queries and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import chat, decontaminate, exact_dedup, filter_audit, language_model, packing, quality, simhash, sql, substrings, token_counts, url_filter, vector_dups, yinyang
from cadenza.llm.common import fold, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def byte_bpe() -> str:
    """The public tokenizer file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Words between those of an item that a proximity match may have.
NEAR_SLACK = 10


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=NEAR_SLACK)
    sha = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


#: Scores below it mark a text as label 0.
ACCEPT = 0.3


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


#: The contract's rules.
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), RULES, url_filter.word_counts(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changed = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    changed = changed.select("row", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return base.join(changed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "longest"
    )


#: The fixed conversation of the contract.
PROBE = r"""
SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    back = chat.read_back(chat.format_chat(turns, vocabulary=byte_bpe()))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def piece_file() -> str:
    """The public piece vocabulary that tokens are counted by."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_file())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = yinyang.cluster(table(spark, sf_dir, "embeddings"))
    sha = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))


def op13_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pack_binary": op2_pack_binary,
    "op3_decontaminate": op3_decontaminate,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_yinyang": op12_yinyang,
    "op13_vector_dups": op13_vector_dups,
}

SQL = {
    "op9_simhash": sql.NEAR_DUPLICATES,
    "op11_filter_audit": sql.FILTER_AUDIT,
    "op12_yinyang": sql.centroids(40, 5),
    "op13_vector_dups": sql.NEAR_VECTORS,
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
""",
    "op3_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, d.k AS k, item_id FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.k = i.k),
places AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id),
-- proximity: from each place of an item's word, do the next len + 10 words hold all of the item's different words?
terms AS (SELECT item_id, len(w) + 10 AS size, list_distinct(w) AS own, unnest(list_distinct(w)) AS word FROM iw WHERE len(list_distinct(w)) > 1),
found AS (
  SELECT doc_id, p, t.item_id, size, len(own) AS wanted, t.word
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw) d JOIN terms t ON d.word = t.word),
-- the last place of each word up to each found place, by the next place of the same word
spans AS (SELECT *, lead(p) OVER (PARTITION BY doc_id, item_id, word ORDER BY p) AS p2 FROM found),
near AS (
  SELECT a.doc_id, a.item_id FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.item_id = b.item_id
    AND b.p BETWEEN a.p AND a.p + a.size - 1 AND (b.p2 IS NULL OR b.p2 > a.p + a.size - 1)
  GROUP BY a.doc_id, a.item_id, a.p, a.wanted HAVING count(*) = a.wanted),
n_near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN places ON dw.doc_id = places.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id LEFT JOIN n_near ON dw.doc_id = n_near.doc_id
""",
    "op6_url_filter": r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(way, h, p)),
ruled AS (
  SELECT page_id, host, path, regexp_replace(lower(path), '[0-9]', '0', 'g') AS shape, arg_max(h || p, len(h || p)) AS rule, arg_max(way, len(h || p)) AS way
  FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|&#?\w+;', ' ', 'g')), '\p{L}+')) AS word FROM pages)
  GROUP BY word),
total AS (SELECT coalesce(nullif(sum(n), 0), 1) AS t FROM words),
hosts AS (SELECT DISTINCT host FROM ruled),
parts AS (SELECT host, name, count(*) AS times FROM (SELECT host, unnest(regexp_extract_all(host, '\p{L}+')) AS name FROM hosts) GROUP BY host, name),
names AS (SELECT DISTINCT name FROM parts),
ends AS (SELECT name, a, unnest(range(a + 1, len(name) + 1)) AS z FROM (SELECT name, unnest(range(0, len(name))) AS a FROM names)),
known AS (SELECT name, map_from_entries(list((a * 10000 + z, ln(n / t)))) AS m FROM ends JOIN words ON word = substring(name, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)), total GROUP BY name),
-- the likeliest split up to each letter: scores and where its last word begins
best AS (
  SELECT names.name, m, CAST(0 AS BIGINT) AS j, CAST([0.0] AS DOUBLE[]) AS top, CAST([0] AS BIGINT[]) AS back FROM names LEFT JOIN known ON names.name = known.name
  UNION ALL
  SELECT name, m, j, list_append(top, list_max(options)), list_append(back, list_position(options, list_max(options)) - 1)
  FROM (
    SELECT name, m, j + 1 AS j, top, back, [top[i + 1] + coalesce(m[i * 10000 + j + 1], -ln(t + 1) - 2.5 * (j + 1 - i)) for i in range(0, j + 1)] AS options
    FROM best, total WHERE j < len(name))),
split AS (
  SELECT name, back, j AS z FROM best WHERE j = len(name) UNION ALL SELECT name, back, back[z + 1] FROM split WHERE back[z + 1] > 0),
host_tokens AS (
  SELECT host, token, sum(times) AS times FROM (
    SELECT host, substring(parts.name, CAST(back[z + 1] + 1 AS BIGINT), CAST(z - back[z + 1] AS BIGINT)) AS token, times FROM parts JOIN split ON parts.name = split.name
    UNION ALL SELECT host, repeat('0', len(d)), 1 FROM (SELECT host, unnest(regexp_extract_all(host, '[0-9]+')) AS d FROM hosts))
  GROUP BY host, token),
shape_tokens AS (SELECT shape, token, count(*) AS times FROM (SELECT shape, '/' || unnest(regexp_extract_all(shape, '[\p{L}0]+')) AS token FROM (SELECT DISTINCT shape FROM ruled)) GROUP BY shape, token),
learned AS (
  SELECT token, sum(times) FILTER (WHERE way = 'block') AS b, sum(times) FILTER (WHERE way = 'allow') AS a FROM (
    SELECT token, times, way FROM ruled JOIN host_tokens ON ruled.host = host_tokens.host WHERE way IS NOT NULL
    UNION ALL SELECT token, times, way FROM ruled JOIN shape_tokens ON ruled.shape = shape_tokens.shape WHERE way IS NOT NULL)
  GROUP BY token),
sums AS (SELECT coalesce(sum(b), 0) AS b, coalesce(sum(a), 0) AS a, count(*) AS v FROM learned),
weights AS (SELECT token, ln((coalesce(l.b, 0) + 1) / (s.b + s.v)) - ln((coalesce(l.a, 0) + 1) / (s.a + s.v)) AS w FROM learned l, sums s),
prior AS (SELECT ln(count(*) FILTER (WHERE way = 'block') / count(*) FILTER (WHERE way = 'allow')) AS w FROM ruled),
host_odds AS (SELECT host, sum(times * w) AS o FROM host_tokens JOIN weights ON host_tokens.token = weights.token GROUP BY host),
shape_odds AS (SELECT shape, sum(times * w) AS o FROM shape_tokens JOIN weights ON shape_tokens.token = weights.token GROUP BY shape)
SELECT page_id, r.host, path, rule, coalesce(way, CASE WHEN coalesce(h.o, 0) + coalesce(s.o, 0) + prior.w > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN host_odds h ON r.host = h.host LEFT JOIN shape_odds s ON r.shape = s.shape, prior
""",
    "op8_chat_format": r"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, p.turn, p.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(turn, role)),
-- tokens at most: one for a known word, bytes for any other piece
known AS (SELECT unnest(string_split('KNOWN_WORDS', '|')) AS word),
named AS (SELECT row_number() OVER () AS r, * FROM own),
written AS (SELECT r, '### ' || role || ': ' || regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS t FROM named),
bounds AS (
  SELECT r, sum(CASE WHEN word IS NULL THEN strlen(p) ELSE 1 END) AS tokens
  FROM (SELECT r, unnest(regexp_extract_all(t, '''(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s')) AS p FROM written) LEFT JOIN known ON p = word GROUP BY r),
sized AS (
  SELECT conv_id, turn, role, text, CAST(tokens AS BIGINT) AS tokens, len(t) AS chars FROM named JOIN written USING (r) JOIN bounds USING (r)),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) - tokens AS before,
    coalesce(first_value(CASE WHEN role = 'system' THEN tokens END) OVER w, 0) AS s_tokens, coalesce(first_value(CASE WHEN role = 'system' THEN chars END) OVER w, 0) AS s_chars
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
-- a turn opens a span in a new chunk of 16 budgets, or where the tokens since the span's first turn would pass the room
cuts AS (
  SELECT conv_id, place, before, before AS since, place AS opened FROM placed WHERE place = 0
  UNION ALL
  SELECT t.conv_id, t.place, t.before, CASE WHEN o THEN t.before ELSE c.since END, CASE WHEN o THEN t.place ELSE c.opened END
  FROM (
    SELECT c.*, t.place AS t_place, t.before // 16384 > c.before // 16384 OR t.before + t.tokens - c.since > 1024 - 256 - t.s_tokens AS o
    FROM cuts c JOIN placed t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.place = c.place + 1) c
  JOIN placed t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.place = c.t_place),
spans AS (
  SELECT c.conv_id, opened, min(p.before) AS since, max(p.before + p.tokens) AS upto, sum(p.chars) AS chars, max(p.s_tokens) AS s_tokens, max(p.s_chars) AS s_chars
  FROM cuts c JOIN placed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.place = c.place GROUP BY c.conv_id, opened),
history AS (
  SELECT s.conv_id, s.opened, sum(p.chars) AS chars
  FROM spans s JOIN placed p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.place < s.opened AND p.place >= s.opened - 2
    AND p.place >= CASE WHEN s.s_tokens > 0 THEN 1 ELSE 0 END AND s.since - p.before <= 256 AND s.upto - p.before <= 1024 - s.s_tokens
  GROUP BY s.conv_id, s.opened),
lengths AS (
  SELECT s.conv_id, sum(s.chars + coalesce(h.chars, 0) + CASE WHEN s.opened > 0 THEN s.s_chars ELSE 0 END) AS formatted_chars
  FROM spans s LEFT JOIN history h ON h.conv_id IS NOT DISTINCT FROM s.conv_id AND h.opened = s.opened GROUP BY s.conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS loss FROM placed GROUP BY conv_id)
SELECT s.conv_id, n_turns, turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM said s JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM s.conv_id
""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(list_slice(w, s, s + 19), ' ') ORDER BY doc_id, s) AS nth
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM windows WHERE nth > 1),
kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS txt, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t
  ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p GROUP BY t.doc_id),
DOUBLINGS
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id
""",
}


def oracles() -> dict[str, str]:
    """The SQL of each query that has any; what comes from a vocabulary's file is written into it."""
    doubled = SQL["op7_substring_dedup"].replace("DOUBLINGS", sql.doublings(20, 11))
    tokens = sql.token_counts(token_counts.pieces_of(piece_file()), token_counts.BYTE_PENALTY)
    return SQL | {"op10_token_counts": tokens, "op7_substring_dedup": doubled, "op8_chat_format": SQL["op8_chat_format"].replace("KNOWN_WORDS", "|".join(chat.known_words(byte_bpe())))}
