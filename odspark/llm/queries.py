"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odspark.llm import (chat_events, decontam, merkle, near_dedup, oracles, packing, quality, secret_ledger,
                         suffix_dedup, token_store, unigram_count, url_filter, variant_grams, window_dedup)
from odspark.llm.staging import ship_package
from odspark.session import staged_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_url_filter(spark, sf_dir):
    """Every page url with its host, path, longest fitting rule and verdict."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@_query
def op2_suffix_dedup(spark, sf_dir):
    """Every document's bytes without 400-byte strings that occur elsewhere."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans",
        F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("kept_sha256"))


@_query
def op3_token_counts(spark, sf_dir):
    """Token count of every document under the unigram reading of the 32k pieces."""
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@_query
def op4_token_store(spark, sf_dir):
    """Every document as read back from the token files: start, ids, checksum."""
    manifest = token_store.write_store(_table(spark, sf_dir, "documents"), token_store.new_folder(spark),
                                       _vocabulary("word_bpe_49k.json"))
    return token_store.read_store(manifest).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


@_query
def op5_minhash_dedup(spark, sf_dir):
    """Near-duplicate component of every document."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("row")


@_query
def op6_decontamination(spark, sf_dir):
    """Every contaminated document and benchmark item with the best matching window."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "window_start", "window_words", "n_common", "n_union")


@_query
def op7_quality_rules(spark, sf_dir):
    """Base counts and verdict of every document."""
    return quality.judge_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_line_words_removed", "base_failed", "kept")


@_query
def op8_substring_dedup(spark, sf_dir):
    """Every document's words without 13-word windows of documents with smaller ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return window_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed",
                                                    F.sha2(words, 256).alias("kept_sha256"))


# A conversation that quotes the control strings of a chat format.
_QUOTING = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
_DELTA_CHARS = 256


def conversation_events(rows: DataFrame) -> DataFrame:
    """The event log of a conversation table, as a chat service would have kept it.

    Assistant texts are streamed as deltas. By the checksum of its text, a third
    of the turns stands at once; a third opens with a draft that is edited, or is
    regenerated while it streams; a third takes both ways, with the edit or the
    second stream as its last word. Drafts, streams and last words of all turns
    lie in one sequence of the conversation: first every turn's opening, then the
    drafts, then the corrections, so the events of a turn are not adjacent in it.
    Repeated (conv, turn) rows are turns of their own, ordered by role and text."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    draft = F.concat(F.reverse(text), F.lit(" <|end|> draft"))
    streamed = F.col("role").eqNullSafe("assistant")
    way = F.crc32(F.encode(text, "UTF-8")) % 3

    def event(phase: int, kind: str, body: Column, step: Column = F.lit(0)) -> Column:
        return F.struct((F.lit(phase) * F.lit(1 << 40) + step).alias("seq"), F.lit(kind).alias("kind"), body.alias("text"))

    def stream(phase: int, body: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(body)), F.lit(_DELTA_CHARS))
        return F.transform(starts, lambda i: event(phase, "delta", F.substring(body, i, F.lit(_DELTA_CHARS)), i))

    empty = F.lit("")
    opened = F.array(event(0, "message", F.when(streamed, empty).when(way == 0, text).otherwise(draft)))
    once = F.when(streamed, F.concat(opened, stream(1, text))).otherwise(opened)
    again = F.when(streamed, F.concat(opened, stream(1, draft), F.array(event(2, "regenerate", empty)), stream(3, text))
                   ).otherwise(F.concat(opened, F.array(event(2, "edit", text))))
    both = F.when(streamed, F.concat(opened, stream(1, draft), F.array(event(2, "edit", draft), event(3, "regenerate", empty)),
                                     stream(4, text))
                  ).otherwise(F.concat(opened, F.array(event(1, "regenerate", empty)), stream(2, draft),
                                       F.array(event(3, "edit", empty)), stream(4, text)))
    log = F.when(way == 0, once).when(way == 1, again).otherwise(both)
    # the turns are numbered in a step of their own, before the events multiply them
    turns = rows.select("conv_id", F.struct("turn", nth.alias("nth")).alias("position"), "role", log.alias("log"))
    return (turns.select("conv_id", "position", "role", F.explode("log").alias("e"))
            .select("conv_id", "position", "role", "e.*"))


@_query
def op9_chat_formatting(spark, sf_dir):
    """Every conversation, rendered and read back: turns, loss text and sizes."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(_QUOTING, rows.schema))
    turns = chat_events.fold_events(conversation_events(rows))
    return chat_events.digest(chat_events.render(turns))


@_query
def op10_packing(spark, sf_dir):
    """Every piece of every document with its place in a sequence."""
    pieces = packing.cut_pieces(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return packing.pack_pieces(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset")


@_query
def op11_secret_scans(spark, sf_dir):
    """Every document's secrets: its one version is scanned against a new ledger."""
    found = secret_ledger.scan_versions(_table(spark, sf_dir, "documents"), staged_path(spark, "secret-ledger"), ["doc_id"])
    base = [r.kind for r in secret_ledger.BASE]
    counts = [secret_ledger.counted("spans", k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secret_ledger.listed("spans", base), 256).alias("base_sha256"),
                        secret_ledger.listed("spans").alias("spans"))


@_query
def op12_merkle_manifest(spark, sf_dir):
    """Every document's leaf, roots and proof; a seventh of the leaves was tampered with before it is verified."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    m = merkle.document_manifest(_table(spark, sf_dir, "documents"), changed=tampered)
    m = m.withColumn("folded_root", merkle.folded(F.col("check_leaf"), F.col("steps")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("steps.h", ""), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@_query
def op13_spelling_variants(spark, sf_dir):
    """Every word of the documents with its more frequent spelling and that form's root."""
    return variant_grams.group_variants(_table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


@_query
def pipeline(spark, sf_dir):
    """The corpus pipeline's last stage: packed pieces."""
    return corpus_pipeline.run(spark, sf_dir)
