"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, mixing, ngram_resampling, prefix_trie, sharding, token_files, topk_search
from .common import Scratch, read_table
from .decontaminate import contamination
from .importance import importance_resample
from .language_id import language_id
from .near_dedup import near_duplicates
from .token_counts import redactions, token_counts
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL if there is any."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return put


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"), shingle_words=3, similarity=0.85)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language_id(read_table(spark, sf_dir, "documents"))


@query("op1_importance_resampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents, and the 80 % that are drawn."""
    return importance_resample(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies of benchmark items."""
    return contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after two edits each."""
    return token_counts(redactions(read_table(spark, sf_dir, "documents")))


@query("op7_sharding", sharding.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after an append of all and a compaction."""
    docs = sharding.shard_documents(spark, read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_id")


@query("op8_chat_format", chat_format.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations."""
    return chat_format.chat_digests(spark, read_table(spark, sf_dir, "conversations"))


@query("op9_mixing", mixing.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn to weights under which none is repeated more than twice."""
    docs = mixing.counted(read_table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "mix_tokens", "mix_nth")
    mixed = mixing.mix(spark, Scratch(spark, "op9").keep(docs, "counted"))
    return mixed.select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_offset").alias("offset_tokens"))


@query("op10_topk_search", topk_search.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector by whole-number inner product."""
    return topk_search.top_k(spark, read_table(spark, sf_dir, "embeddings"))


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's token ids, as read back from the files."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    return token_files.token_digests(token_files.write_token_files(spark, read_table(spark, sf_dir, "documents"), definition))


@query("op12_ngram_resampling", ngram_resampling.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and draw of all documents towards the benchmark's texts."""
    return ngram_resampling.resample(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op13_prefix_trie", prefix_trie.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(spark, read_table(spark, sf_dir, "conversations"))
