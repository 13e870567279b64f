"""Registered queries of the subpackage and the SQL of those it can express."""

from __future__ import annotations

from tokenloom.llm import (bpe, decontam, html, interactions, jaccard, mixing, quality, secrets, tokens, toxicity, urls,
                           warc, whitening)
from tokenloom.sources.tables import read_table


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


QUERIES = {
    "op1_html_extraction": lambda s, d: html.op1(read_table(s, d, "pages", "page_id", "url", "html")),
    "op2_ngram_jaccard_join": lambda s, d: jaccard.op2(_documents(s, d)),
    "op3_toxicity": lambda s, d: toxicity.op3(_documents(s, d), read_table(s, d, "labels", "doc_id", "toxic")),
    "op4_secret_scan": lambda s, d: secrets.op4(_documents(s, d)),
    "op5_warc": lambda s, d: warc.op5(read_table(s, d, "pages", "page_id", "url", "html")),
    "op6_decontamination": lambda s, d: decontam.op6(_documents(s, d), read_table(s, d, "benchmark", "item_id", "text")),
    "op7_mixing": lambda s, d: mixing.op7(read_table(s, d, "documents", "doc_id", "source", "text")),
    "op8_token_ids": lambda s, d: tokens.op8(_documents(s, d)),
    "op9_quality_rules": lambda s, d: quality.op9(_documents(s, d)),
    "op10_url_filter": lambda s, d: urls.op10(read_table(s, d, "pages", "page_id", "url")),
    "op11_embedding_whitening": lambda s, d: whitening.op11(read_table(s, d, "embeddings", "vec_id", "embedding")),
    "op12_filter_audit": lambda s, d: interactions.op12(
        read_table(s, d, "documents", "doc_id", "source", "text"),
        read_table(s, d, "labels", "doc_id", "quality", "toxic")),
    "op13_bpe_codec": lambda s, d: bpe.op13(_documents(s, d)),
}
ORACLE = {"op9_quality_rules": quality.ORACLE_SQL, "op12_filter_audit": interactions.ORACLE_SQL}
