"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import ORACLE as CENTROIDS
from .chat import ORACLE as CHAT
from .common import table
from .top_k import ORACLE as TOP_K


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each row of documents. A null or empty text gets a score too; rows that repeat an id are scored each, and an id
    with several labels is toxic for learning if one of them is 1. Labels of one class only, or none: every score is 0.
    Ties among labelled texts go by hash of the id, id and text. No documents: no rows."""
    from .toxicity import predictions

    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation in canonical turns, and conversation -7. Null text is empty; rows that repeat a turn follow each other by
    role and text; rows with a null conversation are one conversation of that id. No conversations: only -7."""
    from .chat import digest

    return digest(table(spark, sf_dir, "conversations"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rate of each row of documents. Null text has no tokens and the prior's posteriors; null and repeated ids are
    rows of their own. More than 256 languages are an error. `miss` tells how far rates stay from the targets."""
    from .mixing import rates

    return rates(table(spark, sf_dir, "documents"))


def op4_ngram_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and verdict of each row of documents. Null text has no words and fails the base rules; repeated rows are judged each;
    n-grams of one bucket share its ratio. No good label: the base rules alone decide. No documents: no rows."""
    from .quality import verdicts

    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each row of documents. Null texts and those without a letter are `und` with score 0; a text with letters but no
    known n-gram, and ties, get the first language by name. Repeated rows are equal. More than 256 languages are an error."""
    from .language import predictions

    return predictions(table(spark, sf_dir, "documents"))


def op6_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files hold of each row of documents, in ascending id. Null text is the end id alone; null ids come first; rows that
    repeat an id follow each other by text. No documents: no file and no rows."""
    import public_tokenizers

    from .plane_files import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of each query row. Rows with a null id, or a null or non-finite component, take no part; ties go to the
    smaller id; rows that repeat an id are queries and candidates of their own. No query or no other row: no rows."""
    from .top_k import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of documents. Null and blank texts have fingerprint zero; a row with a null id has the
    component of its fingerprint, or null; rows that repeat an id are one node. No documents: no rows."""
    from .simhash import fingerprint_table

    return fingerprint_table(table(spark, sf_dir, "documents"))


def op9_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each row of documents, hashed. Null text is empty: no ids; repeated rows are equal; texts of any length
    and any number of lines are encoded whole. No documents: no rows."""
    import public_tokenizers

    from .byte_bpe import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes of each row of documents. Null text is empty; a row with a null id keeps all its bytes and removes none of
    others; rows that repeat an id don't remove each other's bytes. No documents: no rows."""
    from .suffix_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op11_label_string_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of each row of documents. Null and empty texts, and those whose tokens' bytes differ from them, have zeros and
    ''; each row counts as a document of its own; ties for an A id's best pair are all best. No documents: no rows."""
    import public_tokenizers

    from .alignment import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_sentence_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each row of documents, hashed, and the bytes that the spans cover. Null text is empty: the end id
    alone; repeated rows are equal. No documents: no rows."""
    import public_tokenizers

    from .sentence_piece import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_screened_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each usable vector. Rows that repeat an id are vectors of their own; a null id is assigned but starts no centroid;
    ties go to the smaller number. Fewer vectors than centroids: as many centroids; none: no rows."""
    from .centroids import digest

    return digest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_compression_toxicity, op2_fingerprint_chat_format, op3_soft_mixing, op4_ngram_ratio_quality, op5_bitmask_language, op6_bit_plane_files, op7_histogram_top_k, op8_simhash_gray_index, op9_byte_bpe_transducer, op10_suffix_array_dedup, op11_label_string_alignment, op12_sentence_piece_spans, op13_screened_centroids)}

#: Equivalent DuckDB SQL, where SQL can express the query.
ORACLE_SQL: dict[str, str] = {"op2_fingerprint_chat_format": CHAT, "op7_histogram_top_k": TOP_K, "op13_screened_centroids": CENTROIDS}
