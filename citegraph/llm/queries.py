"""The opN_ queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

from citegraph.llm import decontaminate, language_crf, license_scan, mixing, oracles, partenum, phrase_mining, pu_quality, quality_rules, secret_scan, suffix_dedup, token_alignment, token_output, toxicity
from citegraph.llm.store import documents, labels

QUERIES: dict = {}
#: the others are learned or not relational; tests hold them against brute force
ORACLE: dict[str, str] = {
    "op1_secret_scan": oracles.secret_scan(),
    "op8_decontaminate": oracles.decontaminate(),
    "op10_mixing": oracles.mixing(),
    "op12_phrase_mining": oracles.phrase_mining(),
}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_secret_scan(spark, sf_dir):
    """Secrets of every whole text, by trigram index and verification."""
    return secret_scan.digest(documents(spark, sf_dir))


@_query
def op8_decontaminate(spark, sf_dir):
    """Benchmark windows inside every whole text."""
    return decontaminate.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op10_mixing(spark, sf_dir):
    """Words that the mixture takes of every document."""
    return mixing.digest(documents(spark, sf_dir))


@_query
def op2_token_output(spark, sf_dir):
    """Token ids written as binary blocks and read back."""
    import public_tokenizers

    return token_output.write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op5_quality_rules(spark, sf_dir):
    """Counts, base rules and the learned decision list's verdict."""
    return quality_rules.digest(documents(spark, sf_dir), labels(spark, sf_dir))


@_query
def op3_pu_quality(spark, sf_dir):
    """Quality scores by positive-unlabelled learning."""
    return pu_quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


@_query
def op4_toxicity(spark, sf_dir):
    """Toxicity scores by the weighted finite-state grammar."""
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


@_query
def op9_language_crf(spark, sf_dir):
    """Language of every whole text by the linear-chain CRF."""
    return language_crf.predict(documents(spark, sf_dir))


@_query
def op6_partenum(spark, sf_dir):
    """Components of the near-duplicate links of all documents."""
    return partenum.digest(documents(spark, sf_dir))


@_query
def op7_suffix_dedup(spark, sf_dir):
    """Bytes that repeat a string of 100 bytes, and what is left."""
    return suffix_dedup.digest(documents(spark, sf_dir))


@_query
def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizers' tokens, with corpus-wide counts of the id pairs."""
    import public_tokenizers

    return token_alignment.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op12_phrase_mining(spark, sf_dir):
    """The best collocations of each language, counted by FM-indexes."""
    return phrase_mining.digest(documents(spark, sf_dir))


@_query
def op13_license_scan(spark, sf_dir):
    """Licence notices in every whole text, by a positional index of rare words."""
    return license_scan.digest(documents(spark, sf_dir))
