"""Registry of the queries ``__spark_entry__`` exposes, with their DuckDB
oracles. A query with no oracle entry is checked rows-only by the driver and
against a brute-force reference on a small fixture in ``tests/``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import corpus_queries as cq
from corpusmill.plans import eval_queries as eq
from corpusmill.plans import file_queries as fq
from corpusmill.plans import harvest_queries as hq
from corpusmill.plans import oracle_sql as oq
from corpusmill.plans import stream_queries as sq

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {
    "system_similarity": cq.system_similarity,
    "reply_similarity": cq.reply_similarity,
    "eval_normal_form": cq.eval_normal_form,
    "asm_normal_form": cq.asm_normal_form,
    "asm_normal_form_lines": cq.asm_normal_form_lines,
    "comment_free": cq.comment_free,
    "split_assignment": cq.split_assignment,
    "eval_pairs": cq.eval_pairs,
    "training_set": cq.training_set,
    "missing_kind_report": cq.missing_kind_report,
    "pending_compile": cq.pending_compile,
    "corpus_counts": cq.corpus_counts,
    "tidy_code": cq.tidy_code,
    "quick_asm": cq.quick_asm,
    "sample_inspection": cq.sample_inspection,
    "threshold_split": cq.threshold_split,
    "prediction_samples": cq.prediction_samples,
    "split_metrics": eq.split_metrics,
    "training_tokens": eq.training_tokens,
    "token_batches": eq.token_batches,
    "candidate_ranking": eq.candidate_ranking,
    "evaluation_metrics": eq.evaluation_metrics,
    "code_harvest": hq.code_harvest,
    "code_harvest_tally": hq.code_harvest_tally,
    "link_extraction": hq.link_extraction,
    "section_harvest": hq.section_harvest,
    "harvest_tally": hq.harvest_tally,
    "safe_names": hq.safe_names,
    "reply_code": hq.reply_code,
    "chat_payloads": hq.chat_payloads,
    "compile_gate": hq.compile_gate,
    "compile_tally": hq.compile_tally,
    "candidate_texts": eq.candidate_texts,
    "sorted_listing": cq.sorted_listing,
    "gate_logs": hq.gate_logs,
    "loaded_pairs": fq.loaded_pairs,
    "rewritten_files": fq.rewritten_files,
    "split_lists": fq.split_lists,
    "generated_files": fq.generated_files,
    "named_beside_existing": fq.named_beside_existing,
    "stream_normal_form": sq.stream_normal_form,
    "stream_new_texts": sq.stream_new_texts,
    "stream_reply_tally": sq.stream_reply_tally,
}

ORACLES: dict[str, Callable[[], str]] = {
    "system_similarity": oq.q_system_similarity,
    "reply_similarity": oq.q_reply_similarity,
    "eval_normal_form": oq.q_eval_normal_form,
    "asm_normal_form": oq.q_asm_normal_form,
    "asm_normal_form_lines": oq.q_asm_normal_form,
    "comment_free": oq.q_comment_free,
    "split_assignment": oq.q_split_assignment,
    "eval_pairs": oq.q_eval_pairs,
    "training_set": oq.q_training_set,
    "missing_kind_report": oq.q_missing_kind_report,
    "pending_compile": oq.q_pending_compile,
    "corpus_counts": oq.q_corpus_counts,
    "tidy_code": oq.q_tidy_code,
    "quick_asm": oq.q_quick_asm,
    "threshold_split": oq.q_threshold_split,
    "sample_inspection": oq.q_sample_inspection,
    "prediction_samples": oq.q_prediction_samples,
    "split_metrics": oq.q_split_metrics,
    "training_tokens": oq.q_training_tokens,
    "token_batches": oq.q_token_batches,
    "candidate_ranking": oq.q_candidate_ranking,
    "evaluation_metrics": oq.q_evaluation_metrics,
    "code_harvest": oq.q_code_harvest,
    "code_harvest_tally": oq.q_code_harvest_tally,
    "link_extraction": oq.q_link_extraction,
    "section_harvest": oq.q_section_harvest,
    "harvest_tally": oq.q_harvest_tally,
    "safe_names": oq.q_safe_names,
    "reply_code": oq.q_reply_code,
    "chat_payloads": oq.q_chat_payloads,
    "compile_gate": oq.q_compile_gate,
    "compile_tally": oq.q_compile_tally,
    "candidate_texts": oq.q_candidate_texts,
    "sorted_listing": oq.q_sorted_listing,
    "gate_logs": oq.q_gate_logs,
    "loaded_pairs": oq.q_loaded_pairs,
    "rewritten_files": oq.q_rewritten_files,
    "split_lists": oq.q_split_lists,
    "generated_files": oq.q_generated_files,
    "named_beside_existing": oq.q_named_beside_existing,
    "stream_normal_form": oq.q_stream_normal_form,
    "stream_new_texts": oq.q_stream_new_texts,
    "stream_reply_tally": oq.q_stream_reply_tally,
}


def oracle_sql() -> dict[str, str]:
    return {name: fn() for name, fn in ORACLES.items()}
