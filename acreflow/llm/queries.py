"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .annscan import nearest_neighbours
from .common import documents
from .htmltext import page_texts
from .langid import language_ids
from .licenses import license_digest
from .linededup import line_dedup_digest
from .media import media_features
from .minhash import near_duplicates
from .mixing import mix
from .periodic import runs_digest
from .pieces import encoding_digest
from .secretscan import secret_digest
from .spotsigs import ANTECEDENTS, neighbour_digest, similar_documents
from .turntrie import prefix_trie


def op1_language_id(spark, sf_dir):
    return language_ids(documents(spark, sf_dir))


def op2_html_text(spark, sf_dir):
    return page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_minhash_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op4_media_columns(spark, sf_dir):
    return media_features(documents(spark, sf_dir))


def op5_sentencepiece(spark, sf_dir):
    return encoding_digest(documents(spark, sf_dir))


def op6_line_dedup(spark, sf_dir):
    return line_dedup_digest(documents(spark, sf_dir))


def op7_secret_scan(spark, sf_dir):
    return secret_digest(documents(spark, sf_dir))


def op8_license_scan(spark, sf_dir):
    return license_digest(documents(spark, sf_dir))


def op9_spotsigs(spark, sf_dir):
    return neighbour_digest(documents(spark, sf_dir))


def spotsigs_classes(spark, sf_dir):
    """The length partitions and the pruned Jaccard of operator 9, over all documents."""
    return similar_documents(documents(spark, sf_dir))


def op10_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir)).drop("copies")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_adaptive_neighbours(spark, sf_dir):
    """Every row whose id divides by 50 against all others."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op13_periodic_runs(spark, sf_dir):
    return runs_digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_html_text, op3_minhash_dedup, op4_media_columns, op5_sentencepiece, op6_line_dedup, op7_secret_scan, op8_license_scan, op9_spotsigs, op10_mix_sources, op11_prefix_trie, op12_adaptive_neighbours, op13_periodic_runs, spotsigs_classes)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{table}}),
     pos AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
     keyed AS (SELECT doc_id, line, i, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM pos),
     hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     marked AS (SELECT doc_id, line, i, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN hot USING (k)),
     runs AS (SELECT doc_id, gone, i, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS run FROM marked),
     lengths AS (SELECT doc_id, min(i) AS i, CASE WHEN gone AND min(i) = 1 THEN '0,' ELSE '' END || count(*) AS n FROM runs GROUP BY doc_id, gone, run),
     bitmaps AS (SELECT doc_id, string_agg(n, ',' ORDER BY i) AS keep_bitmap FROM lengths GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256, any_value(keep_bitmap) AS keep_bitmap
FROM marked JOIN bitmaps USING (doc_id) GROUP BY doc_id
"""

_ANTECEDENTS = ", ".join(f"'{w}'" for w in sorted(set(ANTECEDENTS)))

#: Chains of three content words behind common words, and all sets that share a chain.
SPOTSIGS_SQL = f"""
WITH split AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS w FROM documents),
     placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
     marked AS (SELECT *, word IN ({_ANTECEDENTS}) AS common, lag(word IN ({_ANTECEDENTS})) OVER (PARTITION BY doc_id ORDER BY i) AS begins, max(CASE WHEN word NOT IN ({_ANTECEDENTS}, '') THEN i END) OVER (PARTITION BY doc_id) AS last_i FROM placed),
     content AS (SELECT doc_id, word, begins, lead(word) OVER d AS second, lead(word, 2) OVER d AS third FROM marked WHERE NOT common AND i <= last_i WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
     chains AS (SELECT DISTINCT doc_id, word || ' ' || second || ' ' || third AS g FROM content WHERE begins AND third IS NOT NULL),
     sigs AS (SELECT * FROM chains UNION ALL SELECT doc_id, '# ' || array_to_string(w, ' ') FROM split WHERE doc_id NOT IN (SELECT doc_id FROM chains)),
     sets AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS s FROM sigs GROUP BY doc_id),
     classes AS (SELECT s, n, min(doc_id) AS rep FROM sets GROUP BY s, n),
     flat AS (SELECT rep, n, g FROM classes JOIN sigs ON sigs.doc_id = rep),
     pairs AS (SELECT a.rep AS a, b.rep AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS likeness FROM flat a JOIN flat b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n),
     links AS (SELECT a AS rep, count(*) AS n_links, max(likeness) AS nearest FROM pairs WHERE likeness * 100 >= 75 GROUP BY a)
SELECT doc_id, rep AS class_id, coalesce(n_links, 0) AS n_links, nearest FROM sets JOIN classes USING (s, n) LEFT JOIN links USING (rep)
"""

#: CRC-32 of a number's decimal digits: its table of 256 values, named t where ``_crc32`` stands.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc32(column: str) -> str:
    digits = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: All pairs of equal words of a document: a run is a stretch of pairs one period apart.
RUNS_SQL = f"""
WITH crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
     hashed AS (SELECT doc_id, text, {_crc32('doc_id')} AS h FROM documents, crc_table),
     split AS (SELECT doc_id, h, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM hashed),
     sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
     cyclic AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
     words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda x: w[1 + CASE WHEN x < a THEN x ELSE a + (x - a) % p END]) END) AS word FROM cyclic),
     equal AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
     stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, island HAVING count(*) >= greatest(12 - q, q)),
     runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
     told AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS spelled FROM runs GROUP BY doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli, sha256(coalesce(spelled, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Every prefix of every rebuilt conversation, grouped by its turns.
TRIE_SQL = f"""
WITH crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
     original AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     hashed AS (SELECT *, {_crc32('conv_id')} % 6 AS h FROM original, crc_table),
     convs AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS turns FROM hashed c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 100),
     members AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM convs),
     prefixes AS (SELECT conv_id, depth, list_slice(turns, 1, depth) AS prefix, len(turns) = depth AS last FROM members),
     nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends,
                      CASE WHEN depth > 0 THEN (count(*) - 1) * length(prefix[depth].t) ELSE 0 END AS saved FROM prefixes GROUP BY prefix, depth),
     counted AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN nodes p ON p.prefix = list_slice(n.prefix, 1, n.depth - 1) AND p.depth = n.depth - 1
                 LEFT JOIN (SELECT list_slice(prefix, 1, depth - 1) AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c ON c.prefix = n.prefix AND c.depth = n.depth),
     above AS (SELECT prefix, unnest(range(depth + 1)) AS up, saved, n_children = 0 AS leaf FROM counted),
     below AS (SELECT list_slice(prefix, 1, up) AS prefix, up AS depth, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM counted JOIN below USING (prefix, depth)
"""

ORACLES = {"op6_line_dedup": OP6_SQL.format(table="documents"), "op11_prefix_trie": TRIE_SQL, "op13_periodic_runs": RUNS_SQL, "spotsigs_classes": SPOTSIGS_SQL}
