"""The registered queries of this subpackage with their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fleetpulse.llm.common import table
from fleetpulse.llm import collocations, contamination, conversation_repair, minhash_dedup, packing, paragraph_dedup, sharding, suffix_dedup, token_counts, toxicity, url_filter, vector_dedup, wavelet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return add


@query("op7_minhash_near_dedup")
def op7(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query("op3_wavelet_token_files")
def op3(spark, sf_dir):
    return wavelet.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op9_best_fit_packing")
def op9(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op2_url_digest_filter", r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(rhost, rpath, action) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES) + r"""),
fit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
""")
def op2(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op1_toxicity_crf")
def op1(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _contamination_sql(width: int = 5, share: float = 0.8) -> str:
    """The same templates with RE2 patterns; windows are strings instead of hashes."""
    c = contamination
    marked = (f"lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{c.NAME_PATTERN}', '\\1{c.NAME}\\2', 'g'), "
              f"'{c.NUMBER_PATTERN}', ' {c.NUMBER}\\1 ', 'g'), '{c.UNIT_PATTERN}', '\\1 {c.UNIT}\\2', 'g'))")
    raw = f"list_filter(string_split_regex({marked}, '{c.BREAK_PATTERN}'), lambda w: w <> '')"
    mark = f"regexp_matches(w, '^[{c.NUMBER}-{c.NAME}]')"
    def windows(rel: str, key: str, first: int) -> str:
        return (f"SELECT {key}, k, list_aggregate(list_transform(raw[k:k + {width - 1}], lambda w: CASE WHEN {mark} THEN w[1] ELSE w END), "
                f"'string_agg', ' ') AS win, raw[k:k + {width - 1}] AS raw "
                f"FROM (SELECT {key}, raw, unnest(range({first}, len(raw) - {width} + 2)) AS k FROM (SELECT {key}, {raw} AS raw FROM {rel} WHERE {key} IS NOT NULL))")
    return f"""
WITH d AS ({windows("documents", "doc_id", 1)}), i AS ({windows("benchmark", "item_id", 2)}),
sizes AS (SELECT item_id, count(DISTINCT win) AS n_windows FROM i GROUP BY item_id),
hits AS (
  SELECT doc_id, d_i.item_id, n_windows, count(DISTINCT win) / n_windows AS coverage
  FROM (SELECT DISTINCT doc_id, item_id, d.win FROM d JOIN (SELECT DISTINCT item_id, win FROM i) i ON d.win = i.win) d_i
  JOIN sizes ON d_i.item_id = sizes.item_id GROUP BY doc_id, d_i.item_id, n_windows HAVING count(DISTINCT win) >= {share} * n_windows),
met AS (
  SELECT hits.doc_id, hits.item_id, d.k - i.k AS shift, i.k, unnest(i.raw) AS a, unnest(d.raw) AS b
  FROM hits JOIN d ON hits.doc_id = d.doc_id JOIN i ON hits.item_id = i.item_id AND i.win = d.win),
lines AS (
  SELECT doc_id, item_id, shift, count(DISTINCT k) AS n, count(DISTINCT a) AS vals, count(DISTINCT (a, b)) AS maps, min(a = b) AS same
  FROM met WHERE regexp_matches(a, '^[{c.NUMBER}-{c.NAME}]') GROUP BY doc_id, item_id, shift),
slots AS (
  SELECT doc_id, item_id, max(vals) AS n_slots, sum(CASE WHEN vals = maps THEN n ELSE 0 END) / sum(n) AS consistency, max(same) AS same
  FROM lines GROUP BY doc_id, item_id)
SELECT hits.doc_id, hits.item_id, n_windows, coverage, coalesce(n_slots, 0) AS n_slots, coalesce(consistency, 1.0)::DOUBLE AS consistency,
       CASE WHEN coalesce(same, true) THEN 'verbatim' ELSE 'reparameterised' END AS kind
FROM hits LEFT JOIN slots ON hits.doc_id = slots.doc_id AND hits.item_id = slots.item_id
WHERE coalesce(consistency, 1.0) >= {share}"""


@query("op4_template_decontamination", _contamination_sql())
def op4(spark, sf_dir):
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_paragraph_dedup")
def op10(spark, sf_dir):
    found = paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.octet_length("text").cast("long").alias("bytes_left"),
                        F.sha2("text", 256).alias("left_sha256"), "removed")


@query("op6_sorted_projection_dedup", """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, min(r.w) AS component_id, min(r.w) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id GROUP BY e.vec_id
""")
def op6(spark, sf_dir):
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.byte_report(table(spark, sf_dir, "documents"), length=400)


@query("op11_prefix_sum_shards")
def op11(spark, sf_dir):
    return sharding.shard_plan(table(spark, sf_dir, "documents"), shards=40, law="bytes", overhead=16)


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


@query("op13_quotient_filter_collocations", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, 1 AS k, ws[i] AS phrase FROM spots
  UNION ALL SELECT lang, 2, array_to_string(ws[i:i + 1], ' ') FROM spots WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, 3, array_to_string(ws[i:i + 2], ' ') FROM spots WHERE i + 2 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
cand AS (SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2 AND f >= 10),
cparts AS (
  SELECT lang, k, phrase, a, j, array_to_string(parts[1:j], ' ') AS lp, array_to_string(parts[j + 1:], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS parts, unnest(range(1, k)) AS j FROM cand)),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, fl.f AS l, fr.f AS r, (1000000::HUGEINT * c.a * c.a) // (fl.f::HUGEINT * fr.f) AS score
  FROM cparts c JOIN f fl ON fl.lang = c.lang AND fl.phrase = c.lp JOIN f fr ON fr.lang = c.lang AND fr.phrase = c.rp),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
inner_parts AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS part, a FROM cand WHERE k = 3
  UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), a FROM cand WHERE k = 3),
covers AS (SELECT lang, part, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.part = b.phrase AND b.k = 2
  WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000
""")
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"), top=2000, min_count=10, share=50)
