"""The thirteen operators as registered queries over their whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, dac, html_main, mixing, minhash, near_vectors, nearest, oracles, packing, pii, quality, ranked, secrets, sharding
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    """The tokenizer file of the contracts; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_directory(dac.write_tokens(table(spark, sf_dir, "documents"), tokenizer()))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of(table(spark, sf_dir, "documents"), sharding.SHARDS)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": op1,
    "op2_html_main_text": op2,
    "op3_pii_spans": op3,
    "op4_nearest_vectors": op4,
    "op5_quality_scores": op5,
    "op6_packing": op6,
    "op7_source_mixture": op7,
    "op8_token_codes": op8,
    "op9_secret_spans": op9,
    "op10_minhash_near_dedup": op10,
    "op11_conversation_repair": op11,
    "op12_hash_tree_shards": op12,
    "op13_ranked_search": op13,
}

#: Exact links by cosine, components by a recursive walk along them.
_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, c) AS (
  SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.c = l.a
), comp AS (SELECT id, least(min(c), id) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, v.vec_id) AS component_id, v.vec_id = coalesce(comp.c, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.id = v.vec_id
"""

_OP4 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(e, e) > 0
), c AS (SELECT *, row_number() OVER () AS rid FROM ok), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.rid, min(sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS score
  FROM (SELECT DISTINCT vec_id, e FROM ok WHERE vec_id % 100 = 0) q JOIN c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST(([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level, cap / weight AS ratio
  FROM w WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE (arg_min(level, ratio) FILTER (WHERE cap > level * weight) OVER ()) * weight END AS target FROM l
), n AS (
  SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base, target - CASE WHEN target >= source_size THEN 1 ELSE 0 END * source_size AS need FROM t
), g AS (SELECT source, h, sum(size) AS n, count(*) AS m FROM d GROUP BY source, h),
c AS (SELECT source, h, n, m, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (
  SELECT c.source, min(c.h) AS h, arg_min(c.n / c.m, c.h) AS one, arg_min(c.upto - c.n, c.h) AS below, any_value(n.need) AS need
  FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE c.upto > n.need GROUP BY c.source
), k AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS i FROM d)
SELECT d.doc_id, d.size, n.source_size, n.target,
  CAST(d.size * (n.base + CASE WHEN e.h IS NULL OR d.h < e.h OR (d.h = e.h AND d.i <= ceil((e.need - e.below) / e.one - 0.5)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w
), u AS (SELECT DISTINCT doc_id, sh FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
reach(id, c) AS (SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.c = l.a),
comp AS (SELECT id, least(min(c), id) AS c FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id
"""

_OP13 = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (SELECT * FROM t WHERE len(terms) > 0), b AS (SELECT count(*) AS N, CAST(sum(len(terms)) AS BIGINT) AS L FROM s),
u AS (SELECT d, unnest(terms) AS term FROM s), f AS (SELECT d, term, count(*) AS tf FROM u GROUP BY d, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(b.N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f CROSS JOIN b GROUP BY term),
q AS (SELECT item_id, i, term, count(*) AS n FROM (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT d, doc_id, 25 + (75 * len(terms) * N) // L AS m FROM s CROSS JOIN b),
r AS (SELECT q.item_id, q.i, m.doc_id, m.d, CAST(sum(q.n * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (d) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": _OP1,
    "op4_nearest_vectors": _OP4,
    "op7_source_mixture": _OP7,
    "op10_minhash_near_dedup": _OP10,
    "op11_conversation_repair": oracles.conversation_repair(),
    "op12_hash_tree_shards": oracles.hash_tree(),
    "op13_ranked_search": _OP13,
}
