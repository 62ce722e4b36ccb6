"""DuckDB SQL for the results of the queries that SQL can state."""

from __future__ import annotations

from spendcast.llm.decontaminate import WINDOW
from spendcast.llm.lexical import TOP
from spendcast.llm.mixing import BITS, WEIGHTS
from spendcast.llm.phrases import COVERED, FIRST, LEAST, MOST_WORDS, UNKNOWN
from spendcast.llm.quality import LEVEL, MOST_FALSE_REJECTS, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    rate, level = MOST_FALSE_REJECTS / len(RULES), LEVEL / len(RULES)
    measures = ", ".join(f"{m.replace(' div ', ' // ')} AS m_{r}" for r, (m, _) in RULES.items())
    cuts = ", ".join(f"('{r}', {c}, {i})" for r, (_, grid) in RULES.items() for i, c in enumerate(grid))
    values = " UNION ALL ".join(f"SELECT *, '{r}' AS rule, m_{r} AS m FROM good" for r in RULES)
    chosen = ", ".join(f"arg_max(cut, place) FILTER (rule = '{r}') AS c_{r}" for r in RULES)
    broken = " OR ".join(f"coalesce(m_{r} >= c_{r}, false)" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
wins AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d),
named AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM wins),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM named) WHERE n > 1),
reach AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
base AS (
  SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN reach USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {measures} FROM base),
labelled AS (SELECT doc_id AS good_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) >= 1),
good AS (SELECT judged.* FROM judged JOIN labelled ON doc_id = good_id WHERE NOT base_failed),
n AS (SELECT lang, count(*) AS n, (SELECT count(DISTINCT coalesce('=' || lang, '')) FROM good) AS strata FROM good GROUP BY lang),
tail AS (
  SELECT lang, n, strata, k,
         sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rate}) + (n - k) * ln(1 - {rate})))
           OVER (PARTITION BY lang ORDER BY k) AS p
  FROM (SELECT *, unnest(range(0, ceil(n * {rate})::BIGINT + 1)) AS k FROM n)),
permitted AS (SELECT n.lang, max(k) FILTER (p <= {level} / tail.strata) AS k FROM n JOIN tail ON n.lang IS NOT DISTINCT FROM tail.lang GROUP BY n.lang),
grid(rule, cut, place) AS (VALUES {cuts}),
tested AS (
  SELECT v.lang, grid.rule, cut, place, count(*) FILTER (v.m >= cut) AS k
  FROM ({values}) v JOIN grid USING (rule) GROUP BY ALL),
proven AS (
  SELECT tested.lang, {chosen} FROM tested JOIN permitted ON tested.lang IS NOT DISTINCT FROM permitted.lang
  WHERE tested.k <= permitted.k GROUP BY tested.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({broken}) AS kept
FROM judged LEFT JOIN proven ON judged.lang IS NOT DISTINCT FROM proven.lang"""


def _mixing() -> str:
    weights = "[" + ", ".join(f"{w}.0" for w in WEIGHTS) + "]"
    return rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
         ({weights})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW f AS (ORDER BY most / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l),
e AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN round(target / source_size * 2.0 ^ {BITS})::BIGINT ELSE 0 END AS e,
         ('0x' || substr(md5('42/' || coalesce(d.source, '')), 1, {BITS // 4}))::BIGINT AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, (sum(e) OVER (PARTITION BY source ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS p FROM e)
SELECT doc_id, size, source_size, target, ((p + u) >> {BITS}) * size - ((p - e + u) >> {BITS}) * size AS taken FROM p"""


def _sharding(shards: int = 24) -> str:
    wait = "-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || j), 1, 13))::BIGINT + 0.5::DOUBLE) / 16.0::DOUBLE ^ 13)"
    # crc32 from its rule: the table of 256 remainders, then one step for each byte of the text's hexadecimal form
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return rf"""
WITH crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, k: {step}, n::BIGINT) AS v FROM range(256) r(n))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT rid, doc_id, (octet_length(encode(d.t)) + 8)::BIGINT AS size,
         xor(4294967295, list_reduce(
           list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM d, crc),
waits AS (SELECT rid, j, {wait} AS wait FROM d, range({shards + 1}) r(j)),
chosen AS (
  SELECT rid, arg_min(j, (wait, j)) FILTER (j < {shards}) AS shard, arg_min(j, (wait, j)) AS grown FROM waits GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM sized JOIN chosen USING (rid)"""


QUALITY = _quality()
MIXING = _mixing()
SHARDING = _sharding()


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents),
c AS (SELECT rid, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM c),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM c) GROUP BY ALL),
q AS (SELECT DISTINCT iid, item_id, term FROM (SELECT iid, item_id, unnest(w) AS term FROM
      (SELECT row_number() OVER () AS iid, item_id, {TERMS} AS w FROM benchmark))),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf SEMI JOIN q USING (term) GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * n * docs) // words AS m FROM c, whole),
s AS (
  SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}"""


def _phrases() -> str:
    cuts = " UNION ALL ".join(
        f"SELECT lang, g, a, {k} AS k, g[1:{k}] AS x, g[{k + 1}:] AS y FROM cand WHERE len(g) > {k}" for k in range(1, MOST_WORDS)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, g[i:i + {w - 1}] AS g, a FROM (SELECT *, unnest(range(1, len(g) - {w - 2})) AS i FROM cand WHERE len(g) > {w})"
        for w in range(2, MOST_WORDS)
    )
    return rf"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT *, unnest(range(1, least({MOST_WORDS}, len(w) - i + 1) + 1)) AS k FROM spots)),
f AS (SELECT lang, g, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT * FROM f WHERE len(g) > 1),
cuts AS ({cuts}),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.x JOIN f r ON r.lang = c.lang AND r.g = c.y JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g, max(a) AS longer FROM ({inner}) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT lowest.*, array_to_string(g, ' ') AS phrase FROM lowest LEFT JOIN inside USING (lang, g)
      WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
QUALIFY rank <= {FIRST}"""


PHRASES = _phrases()

DECONTAMINATION = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS name, {TERMS} AS w FROM benchmark),
sized AS (SELECT name, w, least({WINDOW}, len(w)) AS l FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT name, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM sized)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents),
g AS (SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
      FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT rid, i, l, name FROM g JOIN win USING (l, s)),
covered AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT rid, i, l FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT rid, name FROM hit WHERE name IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""
