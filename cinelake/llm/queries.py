"""The registered queries of the operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import bpe, dac, decontaminate, divergence, html, langid, linededup, matrixbpe, pii, simhash, topk, toxicity, whitening
from cinelake.llm.common import shared_path, table


def byte_bpe() -> str:
    """Path of the public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def op1_pii_surrogates(spark: SparkSession, d: str) -> DataFrame:
    found = pii.replace(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = linededup.dedupe(table(spark, d, "documents").select("doc_id", "text"))
    dropped = F.size(F.filter("line_classes", lambda x: x["dropped"]))
    return found.select("doc_id", "text", F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"), "line_classes")


def op3_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["past"] - x["first"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    lexicon = toxicity.fit(docs, table(spark, d, "labels"), ~held_out)
    return toxicity.scores(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_main_text(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(table(spark, d, "pages"))


def op8_token_codes(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "llm", "token-codes")
    dac.write(table(spark, d, "documents"), path, byte_bpe())
    return dac.read(spark, path)


def op9_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(table(spark, d, "documents"), byte_bpe())


def op10_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_matrix_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return matrixbpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


def op13_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_line_dedup, op3_language, op4_decontaminate, op5_top_k, op6_toxicity, op7_main_text, op8_token_codes, op9_bpe, op10_simhash, op11_matrix_bpe, op12_whitening, op13_divergence)
}
