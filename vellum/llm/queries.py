"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import attention_mil, bloom_cascade, budget, context_mixing, fm_index, hilbert, hyperminhash, kd_search, patience, ppm
from vellum.llm.runtime import written


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patience.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    partners = F.array_sort(F.array_distinct(F.transform(F.coalesce("removed", F.array()), lambda r: r["partner"])))
    return found.select("doc_id", "n_lines", "n_removed", partners.alias("partners"), "text")


def op2_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kd_search.quantised(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return kd_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    axes = hilbert.document_axes(F.col("size"))
    slim = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    sharded = hilbert.hilbert_shards(written(slim, "shard-documents"), axes, F.struct("doc_id", "text_crc32"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "curve_index", "lang", "source")


def _fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    trees = ppm.fit(docs.where(_fold(5) != 0))
    found = ppm.predict(docs.drop("lang"), trees)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = context_mixing.fit(docs.where(_fold(7) != 2).select("text"))
    found = context_mixing.score(docs, model)
    return found.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: (verdict, host, path): the longest that fits a url decides.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: What names a host for the block list: one of these words in a label.
LISTED_WORDS = r"(^|[.-])(spam|casino|adult|porn|phish|malware|pills)([.-]|$)"


def block_list(pages: DataFrame) -> DataFrame:
    """The key table of the url filter, a row for each listed host."""
    return pages.where(F.col("host").rlike(LISTED_WORDS)).select("host").distinct()


def op7_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    pages = _table(spark, sf_dir, "pages", "page_id", "url").select("page_id", bloom_cascade.host_of(url).alias("host"), bloom_cascade.path_of(url).alias("path"))
    judged, _ = bloom_cascade.mark_listed(pages, block_list(pages))
    rule, verdict = bloom_cascade.rule_of(F.col("host"), F.col("path"), URL_RULES)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "listed")


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    found = fm_index.verdicts(fm_index.contamination(docs, benchmark))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    model = attention_mil.fit(docs, labels.where(_fold(4) != 2))
    found = attention_mil.score(docs, model)
    predicted = (F.col("score") >= attention_mil.THRESHOLD).cast("int")
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", predicted.alias("predicted"))


#: Target weights of the production mixture; a value that is not named weighs 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {}}


def op10_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    levels = {"domain": budget.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return budget.mix(docs, levels, MIX_WEIGHTS, tokens=budget.tokens_of(F.col("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_patience_lines, op2_kd_search, op3_hyperminhash, op4_hilbert_sharding, op5_ppm_language, op6_context_mixing, op7_bloom_cascade, op8_fm_index, op9_attention_mil, op10_hierarchical_budget)}


_OP10 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint) % 4)::varchar, 'other') AS domain,
         coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::hugeint AS tokens FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(tokens)::hugeint * 2 AS capacity, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::hugeint AS weight,
              (sum(sum(tokens)) OVER ())::hugeint * 60 // 100 AS budget FROM leaf GROUP BY domain),
o1 AS (SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
       FROM n1 WINDOW w AS (ORDER BY capacity::double / weight::double, domain)),
f1 AS (SELECT *, capacity * ws::hugeint <= weight * lft::hugeint AS sat FROM o1),
t1 AS (SELECT *, CASE WHEN sat THEN capacity ELSE weight * (budget - sum(CASE WHEN sat THEN capacity ELSE 0 END) OVER ())::hugeint
                 // nullif((sum(CASE WHEN sat THEN 0 ELSE weight END) OVER ())::hugeint, 0) END AS target FROM f1),
n2 AS (SELECT l.domain, l.lang, sum(tokens)::hugeint * 2 AS capacity, CASE l.lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::hugeint AS weight,
              any_value(target) AS budget FROM leaf l JOIN t1 USING (domain) GROUP BY l.domain, l.lang),
o2 AS (SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
       FROM n2 WINDOW w AS (PARTITION BY domain ORDER BY capacity::double / weight::double, lang)),
f2 AS (SELECT *, capacity * ws::hugeint <= weight * lft::hugeint AS sat FROM o2),
t2 AS (SELECT *, CASE WHEN sat THEN capacity ELSE weight * (budget - sum(CASE WHEN sat THEN capacity ELSE 0 END) OVER p)::hugeint
                 // nullif((sum(CASE WHEN sat THEN 0 ELSE weight END) OVER p)::hugeint, 0) END AS target FROM f2 WINDOW p AS (PARTITION BY domain)),
n3 AS (SELECT l.domain, l.lang, l.source, tokens, tokens * 2 AS capacity, 1::hugeint AS weight, target AS budget FROM leaf l JOIN t2 USING (domain, lang)),
o3 AS (SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
              sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
       FROM n3 WINDOW w AS (PARTITION BY domain, lang ORDER BY capacity::double / weight::double, source)),
f3 AS (SELECT *, capacity * ws::hugeint <= weight * lft::hugeint AS sat FROM o3),
t3 AS (SELECT *, CASE WHEN sat THEN capacity ELSE weight * (budget - sum(CASE WHEN sat THEN capacity ELSE 0 END) OVER p)::hugeint
                 // nullif((sum(CASE WHEN sat THEN 0 ELSE weight END) OVER p)::hugeint, 0) END AS target FROM f3 WINDOW p AS (PARTITION BY domain, lang)),
planned AS (SELECT d.*, target, coalesce(target // nullif(tokens, 0), 0) AS full_epochs, coalesce(target % nullif(tokens, 0), 0) AS owed
            FROM d JOIN t3 USING (domain, lang, source)),
ordered AS (SELECT *, md5('7:' || full_epochs::varchar || ':' || coalesce(doc_id::varchar, '(null)')) AS ord FROM planned),
taken AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= owed AS in_prefix FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens, target::bigint AS leaf_target, full_epochs::bigint AS full_epochs, in_prefix,
       (full_epochs + in_prefix::int)::bigint AS copies
FROM taken
"""


_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.doc_id WHERE r.top < e.b)
SELECT d.doc_id, coalesce(any_value(n), 0)::bigint AS n_shingles, min(top) AS component_id, d.doc_id = min(top) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OP7 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
h AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
             regexp_matches(host, '(^|[.-])(spam|casino|adult|porn|phish|malware|pills)([.-]|$)') AS listed FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS width, list_slice(w, k, k + least(len(w), 13) - 1) AS phrase
      FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT width FROM p),
windows AS (SELECT row, k, width, list_slice(w, k, k + width - 1) AS phrase FROM d, sizes, unnest(range(1, len(w) - width + 2)) AS t(k)),
hits AS (SELECT row, k, p.width, item_id FROM windows JOIN p ON windows.width = p.width AND windows.phrase = p.phrase),
covered AS (SELECT row, count(DISTINCT x) AS n_hit FROM hits, unnest(range(k, k + width)) AS t(x) GROUP BY row),
items AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS names FROM hits GROUP BY row)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_kd_search": _OP2, "op3_hyperminhash": _OP3, "op7_bloom_cascade": _OP7, "op8_fm_index": _OP8, "op10_hierarchical_budget": _OP10}
