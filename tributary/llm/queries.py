"""The queries over the operators of this subpackage; ``ORACLES`` has SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .common import table
from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .html_text import page_texts
from .ngram_join import similar_documents
from .oracles import ORACLES  # noqa: F401
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .secrets import scan
from .simhash import near_duplicates
from .spelling import spelling_variants
from .substring_dedup import remove_repeats
from .toxicity import toxicity
from .warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of near duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic archives, their normal form and back."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return read_back(format_conversations(rows))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages rendered as text."""
    return page_texts(table(spark, sf_dir, "pages"))


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of similar documents, over all documents."""
    return similar_documents(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all rebuilt conversations' shared beginnings."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frequent words of all documents, with their more frequent variants."""
    return spelling_variants(table(spark, sf_dir, "documents"))
