"""The thin opN_ queries: each applies one operator, with production parameters, to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, licenses, lm, oracles, secrets, simhash, topk, urls
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def learns(modulus: int, *, held: int):
    """Rows whose crc32 of the id's digits leaves another remainder than `held`; null ids teach nothing."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs, learns(5, held=0))
    found = langid.predictions(docs, models, ["doc_id"])
    return found.select("doc_id", (~learns(5, held=0)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


#: Fixed rules of the query: verdict, then host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that ends a page's path is the document it shows; that document's label is the page's outcome."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = urls.parsed(pages, "page_id", "url").select("host", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0).alias("bad"))
    outcomes = shown.join(labels, "doc_id").select("host", "bad")
    return urls.judge(pages, outcomes, URL_RULES)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"), names.alias("licenses"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = lm.score(docs, learns(7, held=2), path, pattern, size=50_257, end=50_256)
    return found.select("doc_id", (~learns(7, held=2)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.base_only(F.col("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_language, op4_simhash, op5_urls, op6_licenses, op7_lm, op8_secrets, op9_html, op10_topk)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": oracles.DECONTAMINATE,
        "op5_urls": oracles.urls_sql(URL_RULES),
        "op6_licenses": oracles.licenses_sql(),
        "op8_secrets": oracles.secrets_sql(),
        "op10_topk": oracles.TOPK,
    }
