"""The queries of the corpus operators and, where SQL can say them, the same questions as SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelmetry.llm import quality as Q
from voxelmetry.llm import spelling as SP
from voxelmetry.llm.divergence import source_divergence
from voxelmetry.llm.exact_dedup import exact_copies
from voxelmetry.llm.hilbert import hilbert_shards
from voxelmetry.llm.language import identify
from voxelmetry.llm.licenses import scan_licenses
from voxelmetry.llm.minhash import near_duplicate_classes
from voxelmetry.llm.mixing import mix, taken_words
from voxelmetry.llm.pieces import encode_texts
from voxelmetry.llm.quality import robust_outliers
from voxelmetry.llm.simhash import near_duplicates
from voxelmetry.llm.token_counts import count_tokens
from voxelmetry.llm.warc import archive_and_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` becomes ``QUERIES[name]``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_network")
def op1_byte_network(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).drop("text_hash")


def _outlier_sql(steps: int = 5) -> str:
    """The same estimates in SQL: each concentration step is three common table expressions."""
    d = range(Q.DIMENSIONS)
    pairs = [(i, j) for i in d for j in range(i + 1)]
    floors = [f for _, f in Q.STATISTICS]
    number = lambda x: f"{x!r}::DOUBLE"
    moments = ", ".join(
        ["count(*) AS n", *[f"sum(x{i}::HUGEINT) AS s{i}" for i in d], *[f"sum(x{i}::HUGEINT * x{j}) AS s{i}_{j}" for i, j in pairs]]
    )
    totals = ", ".join(f"sum({c}) AS {c}" for c in ["n", *[f"s{i}" for i in d], *[f"s{i}_{j}" for i, j in pairs]])

    def fitted(source: str, factor: float) -> str:
        mean = [f"(s{i}::DOUBLE / n::DOUBLE)" for i in d]
        ridge = {(i, j): floors[i] ** 2 if i == j else 0.0 for i, j in pairs}
        out = [f"{m} / {Q.SCALE} AS m{i}" for i, m in enumerate(mean)]
        out += [f"({number(factor)} * (s{i}_{j}::DOUBLE / n::DOUBLE - {mean[i]} * {mean[j]}) / {number(float(Q.SCALE**2))} + {number(ridge[i, j])}) AS v{i}_{j}" for i, j in pairs]
        made = f"SELECT g, {', '.join(out)} FROM {source}"
        for i, j in pairs:  # one level each: expressions of a level are not repeated in the next one
            rest = f"v{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            made = f"SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l{j}_{j}'} AS l{i}_{j} FROM ({made})"
        return made

    def distances(estimate: str, how: str = "JOIN") -> str:
        made = f"grouped {how} {estimate} USING (g)"
        for i in d:
            rest = f"x{i}::DOUBLE / {Q.SCALE} - m{i}" + "".join(f" - l{i}_{k} * z{k}" for k in range(i))
            made = f"(SELECT *, ({rest}) / l{i}_{i} AS z{i} FROM {made})"
        return f"SELECT *, {' + '.join(f'z{i} * z{i}' for i in d)} AS d2 FROM {made}"

    quartiles = ", ".join(f"quantile_cont(round(x{i} * {number(8 / (f * Q.SCALE))}), [0.25, 0.5, 0.75]) AS q{i}" for i, f in enumerate(floors))
    start = ", ".join(
        [f"q{i}[2] * {number(f / 8)} AS m{i}" for i, f in enumerate(floors)]
        + [f"sqrt(power((q{i}[3] - q{i}[1]) * {number(floors[i] / 8 / 1.349)}, 2) + {number(floors[i] ** 2)}) AS l{i}_{j}" if i == j else f"0.0::DOUBLE AS l{i}_{j}" for i, j in pairs]
    )
    parts = [f"e0 AS MATERIALIZED (SELECT g, {start} FROM (SELECT g, {quartiles} FROM grouped WHERE NOT base_failed AND g IS NOT NULL GROUP BY g))"]
    for k in range(steps):
        parts.append(f"b{k} AS MATERIALIZED (SELECT g, floor(log2(d2 + 1) * {Q.BINS}) AS bin, {moments} FROM ({distances(f'e{k}')}) WHERE NOT base_failed GROUP BY ALL)")
        parts.append(f"""i{k} AS (SELECT * FROM b{k} QUALIFY 2 * (sum(n) OVER (PARTITION BY g ORDER BY bin) - n) < sum(n) OVER (PARTITION BY g) + {Q.DIMENSIONS + 1})""")
        parts.append(f"e{k + 1} AS MATERIALIZED ({fitted(f'(SELECT g, {totals} FROM i{k} GROUP BY g)', Q.consistency(0.5, Q.DIMENSIONS))})")
    limit = number(Q.chi_square_point(0.975, Q.DIMENSIONS))
    parts.append(f"o AS (SELECT g, {moments} FROM ({distances(f'e{steps}')}) WHERE NOT base_failed AND d2 <= {limit} GROUP BY g)")
    parts.append(f"final AS ({fitted('o', Q.consistency(0.975, Q.DIMENSIONS))})")
    statistics = ", ".join(f"round(({e}) * {Q.SCALE})::BIGINT AS x{i}" for i, (e, _) in enumerate(Q.STATISTICS))
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
    tokens AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
    places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM tokens),
    repeated AS (SELECT rid, i FROM places QUALIFY count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY 1),
    counted AS (
      SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '{Q.SYMBOLS}', '')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM tokens LEFT JOIN covered c USING (rid)
    ), judged AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {statistics}, coalesce('=' || lang, '-') AS la, coalesce('=' || source, '-') AS so FROM counted
    ), sized AS (
      SELECT *, coalesce(sum(n) FILTER (WHERE n < {Q.SMALLEST}) OVER (PARTITION BY la), 0) AS pool FROM (SELECT la, so, count(*) AS n FROM judged WHERE NOT base_failed GROUP BY ALL)
    ), tiers AS (
      SELECT *, CASE WHEN n >= {Q.SMALLEST} THEN 0 WHEN pool >= {Q.SMALLEST} THEN 1 ELSE 2 END AS tier FROM sized
    ), grouped AS MATERIALIZED (
      SELECT j.*, CASE tier WHEN 0 THEN la || chr(31) || so WHEN 1 THEN la WHEN 2 THEN CASE WHEN (SELECT sum(n) FROM tiers WHERE tier = 2) >= {Q.SMALLEST} THEN '' END END AS g
      FROM judged j LEFT JOIN tiers USING (la, so)
    ), {", ".join(parts)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(d2 <= {number(Q.chi_square_point(1 - Q.TAIL, Q.DIMENSIONS))}, true) AS kept
    FROM ({distances('final', 'LEFT JOIN')})
    """


@query("op2_robust_outliers", _outlier_sql())
def op2_robust_outliers(spark, sf_dir):
    return robust_outliers(table(spark, sf_dir, "documents")).drop("distance")


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4_exact_dedup(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"), keep="largest").drop("text_hash")


@query("op5_simhash_covering")
def op5_simhash_covering(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op6_distinct_chunks")
def op6_distinct_chunks(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


@query("op10_two_tier_counts")
def op10_two_tier_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op9_golden_schedule",
    r"""
    WITH docs AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id) AS dice FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM docs GROUP BY source
    ), filled AS (
      SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS k, 2 * source_size / weight AS ratio,
             coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS closed, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
      FROM sources WINDOW before AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), levels AS (
      SELECT k, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - closed) / open AS level, ratio FROM filled
    ), targets AS (
      SELECT source, source_size, least(2 * source_size::DOUBLE, (SELECT level FROM levels WHERE level <= ratio ORDER BY k LIMIT 1) * weight) AS target FROM sources
    ), placed AS (
      SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
             sum(size) OVER (PARTITION BY d.source ORDER BY dice, doc_id)::BIGINT - size AS start
      FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           (greatest(0, least(start + size, quota) - start) + greatest(0, least(source_size + start + size, quota) - source_size - start))::BIGINT AS taken
    FROM placed
    """,
)
def op9_golden_schedule(spark, sf_dir):
    return taken_words(mix(table(spark, sf_dir, "documents"))).drop("text_hash")


# CRC-32 by nibbles: one table value for each of four bits, its polynomial is a fixed value
def _crc_step(c: str, nibble: str) -> str:
    values = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        values.append(v)
    return f"xor({c} >> 4, {values}[(xor({c}, {nibble}) & 15) + 1])"


def _code_sql(column: str) -> str:
    return f"""SELECT {column}, floor((coalesce(sum(n) OVER (ORDER BY {column} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + n / 2.0::DOUBLE)
      / sum(n) OVER ()::DOUBLE * 256)::INT AS code FROM (SELECT {column}, sum(rows)::BIGINT AS n FROM groups GROUP BY 1)"""


_BIT = "(7 - step // 3)::INT"
_LOW = f"((1 << {_BIT}) - 1)"


def _turned(axis: str, k: int) -> tuple[str, str]:
    """First coordinate and ``axis`` after a step of the curve on ``axis``."""
    inverted = f"(({axis} >> {_BIT}) & 1) = 1"
    moved = f"(xor(x0, {axis}) & {_LOW})"
    return f"CASE WHEN {inverted} THEN xor(x0, {_LOW}) ELSE xor(x0, {moved}) END", f"CASE WHEN {inverted} THEN {axis} ELSE xor({axis}, {moved}) END"


_FLIP = "0"
for _b in range(7, 0, -1):
    _FLIP = f"xor({_FLIP}, CASE WHEN (y2 >> {_b}) & 1 = 1 THEN {(1 << _b) - 1} ELSE 0 END)"
_CURVE = " + ".join(f"(((xor(y{k}, flip) >> {b})::BIGINT & 1) << {3 * b + 2 - k})" for b in range(8) for k in range(3))


@query(
    "op8_hilbert_runs",
    f"""
    WITH RECURSIVE narrow AS (
      SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS hash,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: ('0x' || b)::BIGINT)),
               lambda c, b: {_crc_step(_crc_step('c', 'b'), '(b >> 4)')}), 4294967295) AS text_crc32
      FROM documents
    ), groups AS (
      SELECT hash, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, any_value(size) AS one, count(*) AS rows, sum(size)::BIGINT AS group_size FROM narrow GROUP BY 1
    ), coded AS (
      SELECT hash, group_size, l.code AS lang_code, s.code AS source_code, least((length(bin(one)) - 1) * 8 + ((one * 8) >> (length(bin(one)) - 1)::INT & 7), 255)::INT AS size_code
      FROM groups g JOIN ({_code_sql('lang')}) l ON g.lang IS NOT DISTINCT FROM l.lang JOIN ({_code_sql('source')}) s ON g.source IS NOT DISTINCT FROM s.source
    ), turned(hash, x0, x1, x2, step) AS (
      SELECT hash, lang_code, source_code, size_code, 0 FROM coded
      UNION ALL
      SELECT hash, CASE step % 3 WHEN 0 THEN CASE WHEN ((x0 >> {_BIT}) & 1) = 1 THEN xor(x0, {_LOW}) ELSE x0 END WHEN 1 THEN {_turned('x1', 1)[0]} ELSE {_turned('x2', 2)[0]} END,
             CASE step % 3 WHEN 1 THEN {_turned('x1', 1)[1]} ELSE x1 END, CASE step % 3 WHEN 2 THEN {_turned('x2', 2)[1]} ELSE x2 END, step + 1
      FROM turned WHERE step < 21
    ), gray AS (
      SELECT hash, x0 AS y0, xor(x1, x0) AS y1, xor(x2, xor(x1, x0)) AS y2 FROM turned WHERE step = 21
    ), curves AS (
      SELECT hash, {_CURVE} AS curve FROM (SELECT *, {_FLIP} AS flip FROM gray)
    ), ordered AS (
      SELECT n.*, group_size, lang_code, source_code, size_code, curve, row_number() OVER o - 1 AS place, sum(size) OVER o - size AS start,
             sum(size) OVER () AS total
      FROM narrow n JOIN coded USING (hash) JOIN curves USING (hash) WINDOW o AS (ORDER BY curve, hash, doc_id ROWS UNBOUNDED PRECEDING)
    ), cut AS (
      SELECT *, least(floor((CASE WHEN group_size <= 0.01::DOUBLE * total::DOUBLE / 16 THEN min(start) OVER (PARTITION BY hash)::DOUBLE + group_size / 2.0::DOUBLE
                               ELSE start::DOUBLE + size / 2.0::DOUBLE END) * 16 / total::DOUBLE), 15)::INT AS shard
      FROM ordered
    )
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard,
           curve::BIGINT AS curve, lang_code, source_code, size_code
    FROM cut
    """,
)
def op8_hilbert_runs(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents")).drop("text_hash")



@query(
    "op3_merged_captures",
    r"""
    WITH captures AS (
      SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, lower(coalesce(url, '')) AS u,
             strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % (3650 * 86400)), '%Y%m%d%H%M%S') AS time
      FROM pages
    ), keyed AS (
      SELECT *, sha1(payload) AS hex, CASE WHEN regexp_matches(u, '^[a-z][a-z0-9+.-]*://')
               THEN array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '.')), ',')
                    || ')' || regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)', 1)
               ELSE u END AS url_key
      FROM captures
    )
    SELECT page_id, strlen(payload) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to,
           row_number() OVER (ORDER BY url_key, time, page_id) - 1 AS position
    FROM keyed
    """,
)
def op3_merged_captures(spark, sf_dir):
    found = archive_and_index(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


@query("op7_patience_alignment")
def op7_patience_alignment(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


# A-Z in lower case, everything else as it is
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_minhash_multi_index",
    rf"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
      SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM docs
    ), nodes AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY s) AS node, s, len(s) AS n, least FROM (SELECT s, min(doc_id) AS least FROM sets GROUP BY s)
    ), each AS MATERIALIZED (
      SELECT node, n, unnest(s) AS t FROM nodes
    ), links AS MATERIALIZED (
      SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.t = b.t AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reached(node, other) AS (
      SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other
    ), classes AS (
      SELECT r.node, min(o.least) AS component_id FROM reached r JOIN nodes o ON o.node = r.other GROUP BY 1
    )
    SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id, doc_id = CASE WHEN n = 0 THEN doc_id ELSE component_id END AS kept
    FROM sets JOIN nodes USING (s) JOIN classes USING (node)
    """,
)
def op11_minhash_multi_index(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query(
    "op12_sorted_list_scan",
    f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
      WHERE length(w) >= {SP.LEAST_LENGTH} GROUP BY ALL
    ), hashed AS (
      SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(doc_id || ':' || w), '..'), lambda b: ('0x' || b)::BIGINT)),
               lambda c, b: {_crc_step(_crc_step('c', 'b'), '(b >> 4)')}), 4294967295) AS h FROM runs
    ), found AS (
      SELECT CASE WHEN h % {SP.DAMAGE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
    ), words AS MATERIALIZED (
      SELECT word, n FROM found WHERE length(word) >= {SP.LEAST_LENGTH} AND n >= {SP.LEAST_COUNT}
    ), without AS MATERIALIZED (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), pairs AS MATERIALIZED (
      SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT w.word, w.n, x.word, x.n FROM without w JOIN words x ON w.rest = x.word
      UNION SELECT x.word, x.n, w.word, w.n FROM without w JOIN words x ON w.rest = x.word
    ), best AS (
      SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM pairs GROUP BY word
    ), formed AS MATERIALIZED (
      SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {SP.TIMES} * w.n THEN best END AS form, CASE WHEN best_n >= {SP.TIMES} * w.n THEN best_n END AS form_n
      FROM words w LEFT JOIN best USING (word)
    ), followed(word, root) AS (
      SELECT word, word FROM formed UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root AND g.form IS NOT NULL
    )
    SELECT word, form, f.root, n, n_near, form_n FROM formed JOIN followed f USING (word) WHERE f.root NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)
    """,
)
def op12_sorted_list_scan(spark, sf_dir):
    return SP.spelling_groups(table(spark, sf_dir, "documents"))


@query(
    "op13_late_strings",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, """ + _LOWERED + r""" AS text FROM documents
    ), terms AS MATERIALIZED (
      SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs) GROUP BY ALL
    ), kept AS MATERIALIZED (
      SELECT lang, term, sum(n) AS n FROM terms GROUP BY 1, 2 HAVING count(*) >= 10
    ), langs AS (
      SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1
    ), groups AS (
      SELECT DISTINCT lang, source FROM docs
    ), counts AS MATERIALIZED (
      SELECT lang, source, term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM groups JOIN kept k USING (lang)
      LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM terms GROUP BY ALL) c USING (lang, source, term)
    ), totals AS (
      SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2
    ), shares AS MATERIALIZED (
      SELECT c.lang, c.source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (t.total + 2 * v) AS p, 1 + 1000000000::HUGEINT * (n_lang + 2) // (l.total + 2 * v) AS q
      FROM counts c JOIN totals t USING (lang, source) JOIN langs l ON l.lang = c.lang
    ), pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY ALL
    ), shown AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM shown
    QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op13_late_strings(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))
