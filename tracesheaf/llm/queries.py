"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesheaf.llm import bpe, exactdedup, langid, mixing, pii, quality, runs, simhash, syncmers, topk, urlfilter, variants, warc
from tracesheaf.llm.common import WORD, held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path).select("doc_id", "ids")
    back = bpe.decode(encoded, path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out("doc_id")))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id")))
    found = docs.select("doc_id", langid.predict_column(spark, model).alias("p"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "p.lang_pred", "p.score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda c: c["base"])
    of = lambda k: F.filter("pii", lambda c: c["base"] & (c["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated filter list over the hosts and sites of ``pages``: three entries for each, dates and actions drawn from a digest of the name."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("h")).where("h <> ''")
    names = hosts.union(hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)).where(F.length(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)) > 0)).distinct()
    pick = lambda j: F.ascii(F.substring(F.md5(F.col("h").cast("binary")), j, 1))
    action = lambda j: F.when(pick(j + 3) % 3 == 0, "allow").when(pick(j + 3) % 3 == 1, "block").otherwise("remove")
    entry = [F.struct(F.col("h").alias("pattern"), ((pick(j) * 7 + j * 131) % 365).cast("long").alias("listed_at"), action(j).alias("action")) for j in (1, 2, 3)]
    return names.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.pmod("page_id", F.lit(365)).cast("long").alias("fetched_at"))
    found = urlfilter.evaluate(captures, list_entries(pages))
    return found.select("page_id", "host", "fetched_at", "verdict", "pattern", "valid_from")


def op11_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def typed_with_slips(docs: DataFrame) -> DataFrame:
    """One row (word) for each run of six letters or more: lower-cased, and one letter short where 199 divides the crc32 of id and run."""
    found = variants.letter_runs(docs)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    at = F.pmod(h, F.char_length("word")).cast("int")
    short = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return found.select(F.when(h % 199 == 0, short).otherwise(F.col("word")).alias("word"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(typed_with_slips(table(spark, sf_dir, "documents")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each tenth document by crc32 of its id goes round a stretch of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def again(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_repeats(table(spark, sf_dir, "documents"))).select("doc_id", "periodic.*")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumns({"top": longest, "lines": F.array_join(lines, "")})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("(1000 * top.length) div -top.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_bpe, op2_mixing, op3_quality, op4_warc, op5_langid, op6_topk, op7_simhash, op8_syncmers, op9_pii, op10_urlfilter, op11_exactdedup, op12_variants, op13_runs, pipeline)
    return {f.__name__: f for f in found}


_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= 100
"""

_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP10 = r"""
WITH cap AS (SELECT page_id, page_id % 365 AS fetched_at,
  regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS host FROM pages),
names AS (SELECT host AS h FROM cap WHERE host <> '' UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM cap
  WHERE host <> '' AND regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''),
e AS (SELECT h AS pattern, (ascii(substr(md5(h), j, 1)) * 7 + j * 131) % 365 AS valid_from,
  CASE ascii(substr(md5(h), j + 3, 1)) % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' ELSE 'remove' END AS action FROM names, (VALUES (1), (2), (3)) t(j)),
d AS (SELECT pattern, valid_from, max(action) AS action FROM e GROUP BY pattern, valid_from),
i AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM d),
m AS (SELECT c.page_id, c.host, c.fetched_at, i.action, i.pattern, i.valid_from,
  row_number() OVER (PARTITION BY c.page_id, c.host, c.fetched_at ORDER BY length(i.pattern) DESC NULLS LAST) AS r
  FROM cap c LEFT JOIN i ON (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)) AND i.action <> 'remove'
    AND i.valid_from <= c.fetched_at AND (i.valid_to IS NULL OR c.fetched_at < i.valid_to))
SELECT page_id, host, fetched_at::BIGINT AS fetched_at, coalesce(action, 'none') AS verdict, pattern, valid_from::BIGINT AS valid_from FROM m WHERE r = 1
"""


_OP11 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": _OP4, "op6_topk": _OP6, "op10_urlfilter": _OP10, "op11_exactdedup": _OP11}
