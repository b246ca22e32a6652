"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import alignment, bpe, decontaminate, exact_dedup, language, language_model, line_dedup, repeated_text, secrets_scan, sharding, simhash, token_counts, vector_codes
from planloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the public tokenizers that are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(make: Query) -> Query:
    @wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir)

    QUERIES[make.__name__] = run
    return run


@query
def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir))


@query
def op2_language_model_scores(spark, sf_dir):
    docs = table(spark, sf_dir).select("doc_id", "text")
    out = language_model.held_out(F.col("doc_id"))
    scored = language_model.score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir).select("doc_id", "text", "lang")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup.drop_shared_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_token_counts(spark, sf_dir):
    pieces = token_counts.load_pieces(vocabulary("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir), pieces)


@query
def op6_repeated_passages(spark, sf_dir):
    kept = repeated_text.remove_repeats(table(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return encoded.select("doc_id", "n_tokens", *digests)


@query
def op7_bpe_encode_decode(spark, sf_dir):
    return bpe_digests(bpe.encode_decode(table(spark, sf_dir), vocabulary("word_bpe_49k.json")))


@query
def op8_secret_scan(spark, sf_dir):
    found = secrets_scan.scan(table(spark, sf_dir))
    held_out = secrets_scan.held_out(F.col("doc_id")).alias("held_out")
    return found.select(
        "doc_id", held_out, "position", F.sha2("core", 256).alias("core_sha256"), "known", "probability", "is_secret"
    )


@query
def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir))


@query
def op11_tokenizer_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op12_vector_codes(spark, sf_dir):
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256")
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", digest)


@query
def op13_balanced_shards(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", F.col("slot").cast("long").alias("slot"), grown)
