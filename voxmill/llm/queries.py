"""One query per operator, with production parameters, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import decision_lists, decontaminate, html_text, language_model, mixing, order_minhash, periodic, prefix_trie, sharding, simhash, token_store, toxicity, url_rules
from voxmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 64
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its number: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")) == 1
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    return url_rules.judge(pages, pages.join(labels, "page_id"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_store.fresh_folder(spark)
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        token_store.write(table(spark, sf_dir, "documents"), folder, file.read(), END_ID)
    return token_store.documents(token_store.read(spark, folder))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op7_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, sharding.shard_names(SHARDS)).select("doc_id", "slot", "shard")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.score(table(spark, sf_dir, "documents"), held_out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text, with the verdict of the base rules and of rules learned from ``labels.quality``."""
    docs = table(spark, sf_dir, "documents")
    return decision_lists.judge(docs, decision_lists.fit(docs, table(spark, sf_dir, "labels")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, a tenth of the texts with a periodic tail; a null id has no crc32, so its text stays as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.find(docs.withColumn("text", periodic.with_tail(F.col("doc_id"), F.col("text")))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations; rows without a conversation id belong to none."""
    return prefix_trie.nodes(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


CATALOG: dict[str, Query] = {
    "op1_url_rules": op1_url_rules,
    "op2_order_minhash": op2_order_minhash,
    "op3_mix_sources": op3_mix_sources,
    "op4_simhash_components": op4_simhash_components,
    "op5_token_store": op5_token_store,
    "op6_main_text": op6_main_text,
    "op7_contained_items": op7_contained_items,
    "op8_shard_lookup": op8_shard_lookup,
    "op9_context_tree": op9_context_tree,
    "op10_toxicity": op10_toxicity,
    "op11_quality_rules": op11_quality_rules,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}
