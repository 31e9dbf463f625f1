"""The registered queries of this folder and the DuckDB statements of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchlight.llm import (
    decontamination, jaccard, manifest, mixing, negatives, phrases, quality, recipes, sharding, substrings, tokencount, toxicity, vectors,
)
from patchlight.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.read_vocabulary())


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_mix_sources, op3_ngram_jaccard, op4_toxicity, op5_token_counts, op6_phrase_dedup,
        op7_decontaminate, op8_embedding_dedup, op9_suffix_dedup, op10_shard, op11_hard_negatives, op12_merkle_manifest, op13_exact_dedup,
    )
}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER p AS place, total - (sum(cap) OVER p - cap) AS rest, sum(weight) OVER () - (sum(weight) OVER p - weight) AS rest_weight
      FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(arg_min(rest::DOUBLE / rest_weight::DOUBLE, place) FILTER (WHERE cap * rest_weight > rest * weight), 0) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target,
             CAST('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 5) AS INT)::DOUBLE / 1048576 AS u FROM w, l),
k AS (SELECT doc_id, size, source_size, target, u, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) - 1 AS k,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor((k + 1) * rate + u) - floor(k * rate + u))::BIGINT * size AS taken FROM k
"""

_COMPONENTS = """
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
"""

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
{_COMPONENTS}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(r.low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)
"""

_OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r
      FROM (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i : i + 19], ' ')))) AS g
            FROM w WHERE len(w) >= 20)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM g WHERE r > 1), (SELECT unnest(range(0, 20)) AS j)),
kept AS (SELECT doc_id, any_value(n) - count(word) AS n_removed, string_agg(word, ' ' ORDER BY i) AS kept
         FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w SEMI JOIN gone USING (doc_id)) ANTI JOIN gone USING (doc_id, i)
         GROUP BY doc_id),
all_gone AS (SELECT doc_id FROM gone ANTI JOIN kept USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN all_gone.doc_id IS NOT NULL THEN len(w) ELSE coalesce(n_removed, 0) END::BIGINT AS n_removed,
       sha256(CASE WHEN all_gone.doc_id IS NOT NULL THEN '' ELSE coalesce(kept, array_to_string(w, ' ')) END) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN all_gone USING (doc_id)
"""

_OP8 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda c: isfinite(c)))
        AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id < q.vec_id
          WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
{_COMPONENTS}
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM e GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
"""

_OP11 = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(embedding) = len(list_filter(embedding, lambda c: isfinite(c)))),
s AS (SELECT a.k AS a, a.vec_id AS anchor_id, v.k, v.vec_id, v.label = a.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score
      FROM v a JOIN v ON len(a.x) = len(v.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, k, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND k <> a
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.k ORDER BY score DESC, vec_id) <= 5
"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
_LEVELS = """
up{0} AS (SELECT tree, 0 AS h, idx, n, digest FROM base{0} UNION ALL
     SELECT tree, h + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM up{0} WHERE n > 1 GROUP BY tree, h, idx // 16),
beside{0} AS (SELECT tree, h, idx, coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                  coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM up{0} WHERE n > 1 WINDOW w AS (PARTITION BY tree, h, idx // 16 ORDER BY idx)),
"""
_FOLD = """
fold{0} AS (SELECT k, tree, 0 AS h, idx, proof, folded FROM start{0} UNION ALL
     SELECT k, f.tree, f.h + 1, f.idx // 16, proof || l || r, sha256(l || folded || r) FROM fold{0} f JOIN beside{0} b ON b.tree = f.tree AND b.h = f.h AND b.idx = f.idx),
"""

_OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, source, sha256({_ROW} || {_FIELD.format('text')}) AS leaf,
       CASE WHEN {_CRC} % 5 = 0 THEN sha256({_ROW} || {_FIELD.format(_LOW)}) END AS copy FROM documents),
t AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
base1 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
                 leaf AS digest, k, doc_id, coalesce(copy, leaf) AS copy FROM t),
{_LEVELS.format('1')}
subroots AS (SELECT tree, digest FROM up1 WHERE n = 1),
base2 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, digest FROM subroots),
{_LEVELS.format('2')}
start1 AS (SELECT k, tree, idx, '' AS proof, copy AS folded FROM base1),
{_FOLD.format('1')}
start2 AS (SELECT k, 0 AS tree, tree AS idx, proof, folded FROM fold1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY h DESC) = 1),
{_FOLD.format('2')}
done AS (SELECT k, proof, folded FROM fold2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY h DESC) = 1)
SELECT doc_id, base1.digest AS leaf, subroots.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = r.digest AS verified
FROM base1 JOIN done USING (k) JOIN subroots USING (tree), (SELECT digest FROM up2 WHERE n = 1) r
"""

_OP13 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

#: The classifiers and the token counter are beyond SQL, the byte strings and the permutation too slow in it; tests hold those to brute force.
ORACLE: dict[str, str] = {
    "op2_mix_sources": _OP2, "op3_ngram_jaccard": _OP3, "op6_phrase_dedup": _OP6, "op8_embedding_dedup": _OP8, "op11_hard_negatives": _OP11,
    "op12_merkle_manifest": _OP12, "op13_exact_dedup": _OP13,
}
