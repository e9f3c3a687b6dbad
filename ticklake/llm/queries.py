"""The registered queries of this folder: thin forms of its operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, clustering, conversations, decontam, hmm, html_text, minhash, mixing, pii, quality_rules, secret_scan, token_files, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(spark, table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: a row for each document and benchmark item that it holds; other documents have none."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(table(spark, sf_dir, "documents"), with_text=False)


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = classifier.measured(table(spark, sf_dir, "documents"))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = classifier.fit(stats.where(third != 1), table(spark, sf_dir, "labels"))
    scores = classifier.score(stats, model)
    return scores.select("doc_id", (third == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(table(spark, sf_dir, "conversations"))


#: The mix as one sorted prefix sum per source; keys, weights and targets as the operator defines them.
OP4_SQL = r"""
WITH s AS (SELECT doc_id AS id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
r AS (SELECT id, source, size, -ln((CAST('0x' || substr(md5('11:' || id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
  / (1 - 0.75 * least(1.0, 20.0 * (length(t) - length(translate(t, '#*$%&|<>', ''))) / greatest(length(t), 1))) AS rank FROM s),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM z),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS full_at FROM w),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM c WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, full_at) AS level FROM l WHERE level <= full_at),
g AS (SELECT l.source, l.source_size, least(l.cap, coalesce(l.w * f.level, l.cap)) AS target FROM l, f),
p AS (SELECT r.id, r.size, g.source_size, g.target, sum(r.size) OVER (PARTITION BY r.source, r.rank, r.id, r.size) AS tied,
  sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rank, r.id, r.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM p)
SELECT id AS doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - tied / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""

#: Payloads are UTF-8, so DuckDB's strlen counts their bytes.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""

#: One round: the nearest centroid (distance and number in one integer), then floors of means by component.
_OP11_ROUND = """
n{r} AS MATERIALIZED (SELECT v.id, min(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 100 + c.k) AS best FROM v, c{r} AS c GROUP BY v.id),
m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT best % 100 AS k, i, sum(v[i]) AS s, count(*) AS n FROM n{r} JOIN v USING (id), range(1, 65) AS t(i) GROUP BY ALL) GROUP BY k),
c{q} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} AS c LEFT JOIN m{r} AS m ON m.k = c.k),"""

OP11_SQL = (
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 40)),"""
    + "".join(_OP11_ROUND.format(r=r, q=r + 1) for r in range(5))
    + """
f AS (SELECT v.id, min(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 100 + c.k) AS best FROM v, c5 AS c GROUP BY v.id)
SELECT vec_id, CAST(best % 100 AS INTEGER) AS cluster, CAST(best // 100 AS BIGINT) AS distance, CAST(sum(best // 100) OVER (PARTITION BY best % 100) AS BIGINT) AS cluster_inertia,
  CAST(sum(best // 100) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM f JOIN v USING (id) JOIN c5 AS c ON c.k = best % 100
"""
)

#: A node is named by the hashes of its turns so far; what a conversation passes on goes to all nodes before it on its path.
OP13_SQL = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM o)),
r AS (SELECT c, i, role, text FROM ids JOIN o ON o.conv_id = c - c % 100 AND i <= h UNION ALL SELECT c, CASE WHEN n < h THEN n ELSE h END + i - h, role, text
  FROM ids JOIN (SELECT ids.c AS cc, coalesce(max(o.i), 0) AS n FROM ids LEFT JOIN o ON o.conv_id = c - c % 100 GROUP BY 1) ON cc = c JOIN o ON o.conv_id = c AND i > h),
p AS (SELECT c, 0 AS d, '' AS node, NULL AS parent, 0 AS chars FROM ids UNION ALL
  SELECT c, d, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY d), chars FROM (SELECT c, i AS d, length(text) AS chars,
    sha256(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY i) OVER (PARTITION BY c ORDER BY i)) AS node FROM r)),
e AS (SELECT c, max(d) AS ends FROM p GROUP BY c),
n AS MATERIALIZED (SELECT node, d, any_value(parent) AS parent, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(CASE WHEN d = ends THEN c END, ',' ORDER BY c), '') AS members FROM p JOIN e USING (c) GROUP BY node, d),
k AS (SELECT a.*, (SELECT count(*) FROM n AS b WHERE b.parent = a.node AND b.d = a.d + 1) AS n_children FROM n AS a),
s AS (SELECT p.node, p.d, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.chars) AS saved_tokens FROM k JOIN p ON p.c = k.conv_id AND p.d <= k.d GROUP BY ALL)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.members) AS ends_sha256
FROM k JOIN s ON s.node = k.node AND s.d = k.d LEFT JOIN n AS up ON up.node = k.parent AND up.d = k.d - 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_minhash": op2_minhash,
        "op3_token_files": op3_token_files,
        "op4_mixing": op4_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_secret_scan": op6_secret_scan,
        "op7_quality_rules": op7_quality_rules,
        "op8_hmm": op8_hmm,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_warc": op10_warc,
        "op11_clustering": op11_clustering,
        "op12_html_text": op12_html_text,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op10_warc": OP10_SQL, "op11_clustering": OP11_SQL, "op13_conversation_trie": OP13_SQL}
