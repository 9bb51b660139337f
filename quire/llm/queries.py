"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import arrowseq, chat, langid, llr, ogg, packing, parity, unigram, urlrules, warc
from .shared import table

MODEL = os.path.join(os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table("documents", spark, sf_dir))


def op2_sentencepiece(spark, sf_dir):
    return unigram.encode(table("documents", spark, sf_dir), unigram.load(MODEL))


def op3_warc_derivatives(spark, sf_dir):
    return warc.derive(warc.responses(table("pages", spark, sf_dir)))


def op4_ogg_packets(spark, sf_dir):
    return ogg.packets(ogg.conversations_as_ogg(table("conversations", spark, sf_dir)))


def op5_language_id(spark, sf_dir):
    docs = table("documents", spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op6_url_rules(spark, sf_dir):
    """The tables label no URL. Weak labels stand in: every page counts, and is bad if a word of its host's name is in ``urlrules.SEEDS``."""
    pages = table("pages", spark, sf_dir)
    return urlrules.apply_rules(pages, urlrules.mine(pages, urlrules.weak_labels(pages)))


def op7_chat_windows(spark, sf_dir):
    return chat.format_windows(table("conversations", spark, sf_dir), model=unigram.load(MODEL))


def op8_ngram_jaccard_join(spark, sf_dir):
    return parity.links(table("documents", spark, sf_dir))


def op9_quality_llr(spark, sf_dir):
    docs = table("documents", spark, sf_dir)
    return llr.score(docs, llr.fit(docs, table("labels", spark, sf_dir)))


def op10_arrow_sequences(spark, sf_dir):
    return arrowseq.write(table("documents", spark, sf_dir), unigram.load(MODEL), arrowseq.new_folder(spark))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_sentencepiece, op3_warc_derivatives, op4_ogg_packets, op5_language_id, op6_url_rules, op7_chat_windows, op8_ngram_jaccard_join, op9_quality_llr, op10_arrow_sequences)}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')"
ORACLE_SQL: dict[str, str] = {
    "op8_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
 s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 j AS (SELECT doc_a, doc_b, (c = x.n AND c = y.n) AS same FROM p JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b WHERE c >= 0.7 * (x.n + y.n - c)),
 e AS (SELECT doc_a AS x, doc_b AS y, same FROM j UNION ALL SELECT doc_b, doc_a, same FROM j),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
 SELECT doc_id, class_id, copies, links FROM (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY 1)
 JOIN (SELECT d.doc_id, count(e.x) FILTER (e.same) AS copies, count(e.x) AS links FROM documents d LEFT JOIN e ON e.x = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY 1) USING (doc_id)"""
}
