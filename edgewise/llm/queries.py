"""One thin query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.llm import archives, html_wrappers, latent_leaks, line_templates, packing, pitman_yor, quality, quotations, secret_forest, simhash, spelling, suffix_repetition, turn_repair
from edgewise.session import read_table


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod(3) != 1)
    out = quality.quality_scores(read_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_tokenizer(), with_ids=False).drop("ids")


def op7_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repetition.repetition(read_table(spark, sf_dir, "documents"))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotations.conversations(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "parent_conv", "parent_turn", F.col("n_quoted").cast("long").alias("n_quoted"), "n_links", "thread")


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_wrappers.extract(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_forest.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "place", F.sha2(F.col("word").cast("binary"), 256).alias("word_sha256"), "score", "secret")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = pitman_yor.scores(docs, crc_mod(10) != 0)
    return out.select("doc_id", (crc_mod(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(read_table(spark, sf_dir, "pages")).drop("url")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return turn_repair.repairs(turn_repair.damaged(rows), rows)


QUERIES = {f.__name__: f for f in (op1_line_templates, op2_quality_classifier, op3_latent_leaks, op4_power_of_two_packing, op5_quotation_linking, op6_html_wrappers, op7_suffix_repetition, op8_simhash_variants, op9_secret_forest, op10_pitman_yor, op11_spelling_variants, op12_arc_to_warc, op13_turn_repair)}
ORACLE_SQL: dict[str, str] = {"op1_line_templates": line_templates.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_arc_to_warc": archives.ORACLE, "op13_turn_repair": turn_repair.ORACLE}
