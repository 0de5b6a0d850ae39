"""The numbered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import bpe, collocations, embeddings, fill_in_middle, licenses, minhash, mixing, packing, quality_classifier, quality_rules, secrets, url_filters, warc
from rallyframe.llm.text import count_words
from rallyframe.plans.scratch import scratch_path, sized_join, stash
from rallyframe.plans.tables import table


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)
    return packed.drop("ids")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"), least=0.95)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels").where("quality = 1"), more=["doc_id"])


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4, threshold=0.8)


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    thin = stash(table(spark, folder, "documents").select("doc_id", "source", count_words(F.col("text")).alias("words")), "sizes")
    mixed = mixing.mix(thin, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.forest_of(docs))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fifth = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    labels = table(spark, folder, "labels").where(fifth != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality_classifier.train(sized_join(docs.select("doc_id", "text"), labels, ["doc_id"], "inner", labels.count()))
    return quality_classifier.classify(docs, model).select("doc_id", (fifth == 0).alias("held_out"), "score", "predicted")


URL_RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(table(spark, folder, "pages"), URL_RULES)


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    automaton = bpe.automaton_of(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), automaton, keep=["doc_id"]), automaton)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, folder, "documents"), seed=1, keep=["doc_id"]))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"), most_words=3, least=10, top=2000)


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i+3]) END) AS sh FROM w),
h AS (SELECT doc_id, sh FROM s), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM documents JOIN c ON c.a = doc_id LEFT JOIN n USING (doc_id)"""

_OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src, ({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY nul, encode(src)) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, nul, encode(src)) AS k FROM r),
v AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM o),
f AS (SELECT arg_min(lev, k) AS lev FROM v WHERE lev * w <= cap),
t AS (SELECT nul, src, source_size, coalesce(least(cap, f.lev * w), cap) AS target,
  ('0x' || substr(md5('11:' || CASE WHEN nul THEN 'true' ELSE 'false' END || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM v CROSS JOIN f),
n AS (SELECT *, row_number() OVER (PARTITION BY nul, src ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 6))::BIGINT % {mixing.SLOTS}, size, doc_id) AS i FROM d),
x AS (SELECT doc_id, size, source_size, target, u, i, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM n JOIN t USING (nul, src))
SELECT doc_id, size, source_size, target, (size * (floor(rate * i + u) - floor(rate * (i - 1) + u)))::BIGINT AS taken FROM x"""


_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def _op6_sql() -> str:
    rows = [(name, licenses.template_words(text)) for name, text in sorted(licenses.TEMPLATES.items())]
    values = ", ".join(f"('{name}', {licenses.class_of(len(own))}, {own})" for name, own in rows)
    grams = lambda ws: f"list_transform(range(1, len({ws}) - 1), lambda i: {ws}[i:i+2])"
    return f"""
WITH t AS (SELECT license, class, list_distinct({grams("words")}) AS own FROM (VALUES {values}) x(license, class, words)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[a-z0-9]+') AS ws FROM documents),
s AS (SELECT doc_id, {grams("ws")} AS sh FROM d WHERE len(ws) >= 3),
h AS (SELECT * FROM s WHERE list_has_any(sh, (SELECT flatten(list(own)) FROM t))),
w AS (SELECT doc_id, class, k * class AS start, list_distinct(sh[k * class + 1 : k * class + 2 * class - 2]) AS found
  FROM (SELECT doc_id, sh, class, unnest(range(0, len(sh) // class + 1)) AS k FROM h, (SELECT DISTINCT class FROM t)))
SELECT doc_id, license, min(start)::BIGINT AS start, max(len(list_intersect(own, found))::DOUBLE / len(own)) AS containment
FROM w JOIN t USING (class) WHERE len(list_intersect(own, found))::DOUBLE / len(own) >= {licenses.CONTAINMENT}
GROUP BY 1, 2"""


_OP7_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact
FROM p LEFT JOIN f USING (payload_digest)"""

_OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(us)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT % 100 AS h3, ('0x' || x[25:32])::BIGINT % 100 AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a+1:b], '') AS middle, array_to_string(us[b+1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""

_OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: {'phrase': array_to_string(ws[i:i+k-1], ' '), 'head': array_to_string(ws[i:i+k-2], ' '), 'tail': array_to_string(ws[i+1:i+k-1], ' '), 'first': ws[i], 'last': ws[i+k-1]})) AS x FROM w, (VALUES (1), (2), (3)) x(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, x.phrase AS phrase, any_value(x) AS x, count(*) AS a FROM g GROUP BY lang, k, x.phrase), t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 10),
e AS (SELECT lang, k, phrase, a, 1 AS cut, x.first AS one, x.tail AS two FROM c UNION ALL SELECT lang, k, phrase, a, 2, x.head, x.last FROM c WHERE k = 3),
s AS (SELECT e.*, y.a AS l, z.a AS r, (1000000::HUGEINT * e.a * e.a // (y.a::HUGEINT * z.a))::BIGINT AS score
  FROM e JOIN f y ON y.lang = e.lang AND y.k = cut AND y.phrase = one JOIN f z ON z.lang = e.lang AND z.k = e.k - cut AND z.phrase = two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, x.head AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, x.tail, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY 1, 2),
q AS (SELECT b.lang, b.phrase, b.a, l, r, n, score FROM b JOIN t ON t.lang = b.lang LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase AND k = 2 WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM q QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000"""

QUERIES = {
    "op1_pack": op1_pack,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash": op4_minhash,
    "op5_mix": op5_mix,
    "op6_licenses": op6_licenses,
    "op7_warc": op7_warc,
    "op8_secrets": op8_secrets,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op2_embedding_dedup": _OP2_SQL, "op4_minhash": _OP4_SQL, "op5_mix": _OP5_SQL, "op6_licenses": _op6_sql(), "op7_warc": _OP7_SQL, "op12_fill_in_middle": _OP12_SQL, "op13_collocations": _OP13_SQL}
