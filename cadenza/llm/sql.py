"""SQL that is built by rule or long: XXH64 of byte lists and the near-duplicates that rest on it, filters, clusters."""

from __future__ import annotations

WORD = 1 << 64
# Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def big(x: str) -> str:
    return f"CAST({x} AS UHUGEINT)"


def word(x: object) -> str:
    return f"CAST({x} AS UBIGINT)"


def add(*xs: str) -> str:
    """A sum of 64-bit words, as one."""
    return word(f"({' + '.join(map(big, xs))}) % {WORD}")


def times(x: str, k: int) -> str:
    return word(f"({big(x)} * {k}) % {WORD}")


def turned(x: str, r: int) -> str:
    """Bits turned to the left."""
    return word(f"({big(x)} * {1 << r}) % {WORD} + {big(x)} // {1 << (64 - r)}")


def lane(pos: str, n: int) -> str:
    """n bytes of b from a place on, the lowest first."""
    return add(*(f"b[{pos} + {i + 1}] * CAST({256**i} AS UHUGEINT)" for i in range(n)))


def mixed_in(v: str, x: str) -> str:
    return times(turned(add(v, times(x, P2)), 31), P1)


def xxh64(source: str, seed: int) -> str:
    """CTEs that end in hashed (id, hash): XXH64 of b, a list of bytes as 64-bit words, of each row of source (id, b)."""
    start = [(seed + P1 + P2) % WORD, (seed + P2) % WORD, seed, (seed - P1) % WORD]
    merged = ", ".join(
        f"merged{k} AS (SELECT id, b, pos, v0, v1, v2, v3, CASE WHEN pos = 0 THEN h ELSE {add(times(f'xor(h, {mixed_in(word(0), f"v{k}")})', P1), word(P4))} END AS h FROM {f'merged{k - 1}' if k else 'merged'})"
        for k in range(4)
    )
    return f"""stripes AS (
  SELECT id, b, CAST(0 AS BIGINT) AS pos, {', '.join(f'{word(x)} AS v{k}' for k, x in enumerate(start))} FROM {source}
  UNION ALL SELECT id, b, pos + 32, {', '.join(f'{mixed_in(f"v{k}", lane(f"pos + {8 * k}", 8))} AS v{k}' for k in range(4))} FROM stripes WHERE len(b) - pos >= 32),
merged AS (
  SELECT id, b, pos, v0, v1, v2, v3, CASE WHEN pos = 0 THEN {word((seed + P5) % WORD)} ELSE {add(turned('v0', 1), turned('v1', 7), turned('v2', 12), turned('v3', 18))} END AS h
  FROM stripes WHERE len(b) - pos < 32),
{merged},
steps AS (
  SELECT id, b, pos, {add('h', 'len(b)')} AS h FROM merged3
  UNION ALL SELECT id, b, CASE WHEN len(b) - pos >= 8 THEN pos + 8 WHEN len(b) - pos >= 4 THEN pos + 4 ELSE pos + 1 END,
    CASE WHEN len(b) - pos >= 8 THEN {add(times(turned(f'xor(h, {mixed_in(word(0), lane("pos", 8))})', 27), P1), word(P4))}
      WHEN len(b) - pos >= 4 THEN {add(times(turned(f'xor(h, {times(lane("pos", 4), P1)})', 23), P2), word(P3))}
      ELSE {times(turned(f'xor(h, {times("b[pos + 1]", P5)})', 11), P1)} END
  FROM steps WHERE pos < len(b)),
ended AS (SELECT id, {times('xor(h, h >> 33)', P2)} AS h FROM steps WHERE pos = len(b)),
ended2 AS (SELECT id, {times('xor(h, h >> 29)', P3)} AS h FROM ended),
hashed AS (SELECT id, xor(h, h >> 32) AS hash FROM ended2)"""


#: Fingerprints of four-word shingles, linked at four bits.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
texts AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM shingles)),
source AS (SELECT g AS id, [CAST('0x' || substring(x, 2 * i + 1, 2) AS UBIGINT) for i in range(0, len(x) // 2)] AS b FROM texts),
{xxh64('source', 42)},
bits AS (
  SELECT doc_id, k, sum((hash >> CAST(k AS UBIGINT)) & 1) AS ones, count(*) AS n
  FROM shingles JOIN hashed ON g = id, (SELECT unnest(range(0, 64)) AS k) GROUP BY doc_id, k),
prints AS (
  SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN 2 * ones > n THEN CAST(pow(2, k) AS HUGEINT) ELSE 0 END), 0) AS UBIGINT) AS fp
  FROM d LEFT JOIN bits ON d.doc_id = bits.doc_id GROUP BY d.doc_id),
nodes AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= 4),
reach AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(least) AS component_id FROM reach JOIN nodes ON b = fp GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN roots ON fp = a
"""


#: Every document against every order of the five filters.
FILTER_AUDIT = r"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * len(x), regexp_matches(x, '[#$%&*|]'),
     coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)] AS fails
  FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, good, toxic, fails[instr('ABCDE', filter_order[step])] AS own,
    len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', filter_order[i])])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) AS n
  FROM failed, steps),
counted AS (
  SELECT part, filter_order, step, count(*) FILTER (WHERE NOT own AND NOT earlier) AS kept, count(*) FILTER (WHERE own AND NOT earlier) AS removed,
    count(*) FILTER (WHERE own AND earlier) AS redundant, count(*) FILTER (WHERE own AND n = 1) AS unique_fails,
    count(*) FILTER (WHERE own AND NOT earlier AND good = 1) AS good_lost, count(*) FILTER (WHERE own AND NOT earlier AND toxic = 1) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT * REPLACE (CAST(step AS INTEGER) AS step), CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM counted
"""

#: All pairs of a label, and what can be reached by them.
NEAR_VECTORS = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
valid AS (
  SELECT * FROM rows WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM valid a JOIN valid b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
reach AS (SELECT r AS a, r AS b FROM rows UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN rows ON b = r GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN least ON r = least.a LEFT JOIN counts ON r = counts.a
"""


def centroids(k: int, rounds: int, dims: int = 64) -> str:
    """All distances in every round."""
    steps = ""
    for i in range(rounds + 1):
        steps += f""",
a{i} AS MATERIALIZED (
  SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c}}) AS best FROM own, c{i} GROUP BY r)"""
        if i < rounds:
            steps += f""",
s{i} AS (
  SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY j) AS z
  FROM (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN own ON a{i}.r = own.r, (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY best.c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, CAST(coalesce(s{i}.z, c{i}.z) AS BIGINT[]) AS z FROM c{i} LEFT JOIN s{i} ON c{i}.c = s{i}.c)"""
    last = rounds
    return f"""
WITH own AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT h, v FROM own ORDER BY h, v LIMIT {k}))
{steps}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{last} JOIN own ON a{last}.r = own.r JOIN c{last} ON best.c = c{last}.c
"""


def doublings(window: int, levels: int) -> str:
    """longest (doc_id, longest): the greatest doubling of window at which a window of d (doc_id, w) is repeated."""
    out = f"""w0 AS (SELECT doc_id, s AS p, array_to_string(list_slice(w, s, s + {window - 1}), ' ') AS x, '' AS y FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM d WHERE len(w) >= {window}))"""
    for k in range(levels):
        out += f""",
i{k} AS (SELECT x, y, row_number() OVER () AS id FROM w{k} GROUP BY x, y HAVING count(*) > 1),
r{k} AS MATERIALIZED (SELECT doc_id, p, id FROM w{k} JOIN i{k} USING (x, y)),
w{k + 1} AS (SELECT a.doc_id, a.p, a.id AS x, b.id AS y FROM r{k} a JOIN r{k} b ON a.doc_id = b.doc_id AND b.p = a.p + {window << k})"""
    every = " UNION ALL ".join(f"SELECT doc_id, {window << k} AS l FROM r{k}" for k in range(levels))
    return f"{out},\nlongest AS (SELECT doc_id, max(l) AS longest FROM ({every}) GROUP BY doc_id)"


def token_counts(pieces: list[str], penalty: float) -> str:
    """Best cuts of each different word, letter by letter, by Zipf's law over the pieces in order of rank."""
    total, listed = sum(1 / (r + 1) for r in range(len(pieces))), "\x1f".join(pieces).replace("'", "''")
    return rf"""WITH RECURSIVE pieces AS (
  SELECT piece, -ln((r + 1) * {total!r}) AS s FROM (SELECT unnest(l) AS piece, unnest(range(0, len(l))) AS r FROM (SELECT string_split('{listed}', chr(31)) AS l))),
worst AS (SELECT min(s) - {penalty} AS unknown, max(len(piece)) AS longest FROM pieces),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
used AS (SELECT r, word, count(*) AS times FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
tokens AS (SELECT word, '▁' || word AS t FROM (SELECT DISTINCT word FROM used)),
parts AS (SELECT word, t, a, unnest(range(a + 1, least(len(t), a + longest) + 1)) AS z FROM (SELECT word, t, unnest(range(0, len(t))) AS a FROM tokens), worst),
known AS (SELECT word, z, list({{'k': z - a, 's': s}}) AS ends FROM parts JOIN pieces ON piece = substring(t, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) GROUP BY word, z),
-- the best cut up to each letter, of equal ones that of fewest pieces; the last ones are kept
best AS (
  SELECT word, t, CAST(0 AS BIGINT) AS j, [{{'s': CAST(0 AS DOUBLE), 'n': CAST(0 AS BIGINT)}}] AS back FROM tokens
  UNION ALL
  SELECT word, t, j + 1, list_slice(list_prepend(list_max(list_prepend(
      {{'s': back[1].s + unknown * strlen(substring(t, j + 1, 1)), 'n': back[1].n - strlen(substring(t, j + 1, 1))}},
      coalesce(list_transform(ends, lambda e: {{'s': back[e.k].s + e.s, 'n': back[e.k].n - 1}}), []))), back), 1, longest)
  FROM (SELECT b.word, t, j, back, ends, unknown, longest FROM best b LEFT JOIN known k ON k.word = b.word AND k.z = b.j + 1, worst WHERE b.j < len(b.t)))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens
FROM d LEFT JOIN (SELECT r, sum(times * -back[1].n) AS n FROM used JOIN best USING (word) WHERE j = len(t) GROUP BY r) c ON d.r = c.r
"""
