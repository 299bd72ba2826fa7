"""The thin queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, merkle, mixing, ngram_join, ogg, quality, search, substring, tokenpack, toxicity, urlfilter, warc
from .common import table

#: (host, path, action) rules of the URL filter query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Scores from which a document counts as label 1.
TOXIC, GOOD = 0.7, 0.3
END_ID = 2


def word_count(text: Column) -> Column:
    """Runs of other characters than blanks (U+0020, U+0009 to U+000D); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --------------------------------------------------------------------------


def mix_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``size, source_size, target, taken``, in place of columns of these names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    d = docs.select(row.alias("row"), F.col("doc_id").alias("key"), word_count(F.col("text")).alias("size"), F.array("source").alias("sources"))
    mixed = mixing.mix(d, sources="sources", size="size", key="key", weights=mixing.cycle_weights)
    name = mixing.source_key(F.get("sources", 0))
    new = {"size": F.col("size"), "source_size": F.col("source_sizes")[name], "target": F.col("targets")[name], "taken": F.col("taken")[name]}
    return mixed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1 = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         md5('mix|' || doc_id::VARCHAR) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
-- sources in the order in which they reach three times their size
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_w,
         row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS k
  FROM s),
-- the first source that the shared level leaves below its cap
f AS (SELECT min(k) AS k FROM r WHERE w * (total - capped)::DOUBLE / free_w <= 3 * source_size),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.k < f.k THEN (3 * r.source_size)::DOUBLE ELSE (r.w * (x.total - x.capped))::DOUBLE / x.free_w::DOUBLE END AS target
  FROM r, f, r AS x WHERE x.k = f.k),
c AS (
  SELECT d.*, t.source_size, t.target, round_even(t.target, 0)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(quota, start + size) - start)
      + greatest(0, least(quota, start + source_size + size) - (start + source_size))
      + greatest(0, least(quota, start + 2 * source_size + size) - (start + 2 * source_size)))::BIGINT AS taken
FROM c
"""


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.stage(warc.write_bundles(table(spark, sf_dir, "pages")), "bundles")
    return warc.read_records(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INTEGER, 1) for i in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM h
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labelled ``docs`` outside the held-out fold."""
    known = labels.select(F.col("doc_id"), F.col("toxic").alias("label")).filter(fold(F.col("doc_id"), 3) != 1)
    return toxicity.fit(docs, known)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(fold(F.col("doc_id"), 5) != 0)
    out = quality.score(docs, quality.fit(docs, known))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w FROM documents),
b AS (SELECT item_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN win USING (n, gram)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_table(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("text_hash")


OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)] END) AS s FROM d),
tok AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sh),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
link AS (SELECT a, b FROM inter WHERE 100 * c >= 90 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM reach r JOIN edge e ON r.y = e.a),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sh JOIN comp USING (doc_id)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9 = """
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE doc_id > m),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM rep),
wd AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM wd ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.token_table(table(spark, sf_dir, "documents"), tokenizer(), end_id=END_ID)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def _fields_sql(*values: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v} END" for v in values) + ")"


_UP = "[sha256(array_to_string(l[3 * i + 1 : 3 * i + 3], '')) for i in range((len(l) + 2) // 3)]"
_FIRST = "doc_id NULLS FIRST, leaf, shown NULLS FIRST"
# crc32 of the decimal id, bit by bit: each byte, then eight shifts (below 0); it is even where its complement is odd
_EVEN = "list_reduce([4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) % 2 = 1"

OP11 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_fields_sql("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
         CASE WHEN {_EVEN} THEN {_fields_sql("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS shown
  FROM documents),
lev AS (
  SELECT source, 0 AS k, list(leaf ORDER BY {_FIRST}) AS l FROM d GROUP BY source
  UNION ALL SELECT source, k + 1, {_UP} FROM lev WHERE len(l) > 1),
sub AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, k AS n FROM lev WHERE len(l) = 1),
top AS (
  SELECT 0 AS k, list(subroot ORDER BY g) AS l FROM sub
  UNION ALL SELECT k + 1, {_UP} FROM top WHERE len(l) > 1),
-- the levels that a leaf of a source passes, first in its source, then over the sources
step AS (
  SELECT g, k AS s, l, true AS inside, k FROM lev JOIN sub ON lev.source IS NOT DISTINCT FROM sub.source WHERE len(l) > 1
  UNION ALL SELECT g, n + top.k, top.l, false, top.k FROM sub, top WHERE len(top.l) > 1),
spot AS (SELECT rid, row_number() OVER (PARTITION BY source ORDER BY {_FIRST}) - 1 AS p FROM d),
walk AS (
  SELECT rid, p, g, 0 AS s, coalesce(shown, leaf) AS x, '' AS around FROM d JOIN spot USING (rid) JOIN sub ON d.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT rid, p, g, s + 1, sha256(array_to_string(lo || [x] || hi, '')), around || array_to_string(lo || hi, '')
  FROM (SELECT *, CASE WHEN o % 3 = 0 THEN [] ELSE l[o - o % 3 + 1 : o] END AS lo, CASE WHEN o % 3 = 2 THEN [] ELSE l[o + 2 : o - o % 3 + 3] END AS hi
        FROM (SELECT rid, p, w.g, w.s, x, around, l, (CASE WHEN inside THEN p ELSE w.g END // (3 ** k)::BIGINT)::BIGINT AS o FROM walk w JOIN step ON step.g = w.g AND step.s = w.s))),
done AS (SELECT rid, max_by(x, s) AS x, max_by(around, s) AS around FROM walk GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(around) AS proof_sha256, x AS folded_root, x = root AS verified
FROM d JOIN done USING (rid) JOIN sub ON d.source IS NOT DISTINCT FROM sub.source, (SELECT l[1] AS root FROM top WHERE len(l) = 1)
"""


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, coalesce({_TERMS}, []) AS w FROM documents) WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS bid, item_id, coalesce({_TERMS}, []) AS w FROM benchmark),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
q AS (SELECT bid, item_id, t, count(*)::BIGINT AS times FROM (SELECT bid, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
f AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, s GROUP BY t, nn),
x AS (
  SELECT bid, item_id, d.doc_id, d.rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN w USING (t) JOIN d USING (rid), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_warc_bundles, op3_url_filter, op4_toxicity, op5_quality_mil, op6_decontaminate, op7_ogg_media, op8_ngram_join, op9_substring_dedup, op10_token_pack, op11_merkle_manifest, op12_bpe_automaton, op13_ranked_search)}
ORACLES = {"op1_mix_sources": OP1, "op2_warc_bundles": OP2, "op6_decontaminate": OP6, "op8_ngram_join": OP8, "op9_substring_dedup": OP9, "op11_merkle_manifest": OP11, "op13_ranked_search": OP13}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
