"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, language, negatives, ngram_join, pii, quotes, secrets, sharding, topk, toxicity, urls

SHARDS = 40
VOCABULARY, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(_table(spark, sf_dir, "documents"), VOCABULARY)
    n = (F.octet_length("packed") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", "spans").select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op4_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language.remainder("doc_id", 5) == 0
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


#: A document whose score reaches this is called toxic.
TOXIC = 0.7


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language.remainder("doc_id", 3) == 1
    grammar = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def _dated_entries(pages: DataFrame) -> DataFrame:
    """Stand-in for a published list, from digests: some hosts, domains and pages are blocked on a day, some of them freed or allowed later."""
    path = F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    host = pages.select(urls.host_of(F.col("url")).alias("host"), path.alias("path")).where("host <> ''")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    page = host.where(F.length("path") > 1).select(F.concat("host", "path").alias("host"))
    named = host.select("host").union(host.select(domain.alias("host"))).union(page).where("host <> ''").distinct()
    letter = lambda k: F.ascii(F.substring(F.md5(F.col("host").cast("binary")), k, 1))
    day = F.date_add(F.lit("2024-01-01").cast("date"), letter(2) * 7 % 180)
    first = named.where(letter(1) % 3 == 0).select(F.col("host").alias("pattern"), F.lit("block").alias("verdict"), day.alias("since"))
    later = F.when(letter(3) % 2 == 0, F.lit("removed")).otherwise(F.lit("allow"))
    second = named.where((letter(1) % 3 == 0) & (letter(4) % 2 == 0)).select(F.col("host").alias("pattern"), later.alias("verdict"), F.date_add(day, 60).alias("since"))
    return first.union(second)


def op5_url_list_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched_on"))
    judged = urls.filter_captures(captures, _dated_entries(pages))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "since")})


def _quoting(messages: DataFrame) -> DataFrame:
    """The conversations as mail would have them, as the table holds no quotes: replies quote what was said before, whole, in part or nested."""
    said = messages.groupBy("conv_id", F.col("turn").alias("at")).agg(F.min("text").alias("said"))
    before = lambda k: said.select(F.col("conv_id").alias(f"c{k}"), F.col("at").alias(f"t{k}"), F.col("said").alias(f"said{k}"))
    out = messages
    for k in (1, 2):
        out = out.join(before(k), (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") - k == F.col(f"t{k}")), "left")
    marked = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    kind = F.col("turn") % 4
    quote = F.when(kind == 1, marked(F.col("said1"), "> ")).when(kind == 2, marked(F.translate(F.substring_index("said1", "\n", 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ">")).when(kind == 3, F.concat(marked(F.col("said2"), "> > "), marked(F.col("said1"), "> ")))
    return out.select(*[F.concat(F.coalesce(quote, F.lit("")), "text").alias(c) if c == "text" else F.col(c) for c in messages.columns])


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_quoting(_table(spark, sf_dir, "conversations")))


def op11_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.STRICT]
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = alignment.align(_table(spark, sf_dir, "documents"), VOCABULARY, PIECES)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return linked.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_exact_top_k,
            op2_bpe_round_trip,
            op3_pii_weak_supervision,
            op4_byte_balanced_shards,
            op5_url_list_as_of,
            op6_language_hierarchy,
            op7_ngram_jaccard_join,
            op8_quotation_linking,
            op9_toxicity_grammar,
            op10_decontamination,
            op11_linked_secrets,
            op12_cross_tokenizer_alignment,
            op13_hard_negatives,
        )
    }
