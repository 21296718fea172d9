
from corpusmill.plans import source_queries  # noqa: F401  (A)
from corpusmill.plans import prepare_queries  # noqa: F401  (B, C)
from corpusmill.plans import rewrite_queries  # noqa: F401  (D)
from corpusmill.plans import chat_queries  # noqa: F401  (E)
from corpusmill.plans import think_queries  # noqa: F401  (F)
from corpusmill.plans import token_queries  # noqa: F401  (G, H)
from corpusmill.plans import stream_queries  # noqa: F401  (I)
from corpusmill.plans.registry import ORACLE as _ORACLE
from corpusmill.plans.registry import QUERIES as _QUERIES

# operator ids A1 ... I4 in order
ORDER = (
    "read_jsonl",
    "write_jsonl",
    "read_dataset",
    "sanitize_name",
    "paired_sinks",
    "run_manifest",
    "missing_columns",
    "validate_required",
    "route_format",
    "drop_incomplete_qa",
    "format_qa",
    "effective_text",
    "drop_blank_solution",
    "shortest_n",
    "shortest_n_all_strings",
    "shortest_n_per_group",
    "build_request",
    "build_focus_request",
    "rewrite_batches",
    "choose_candidate",
    "apply_verdict",
    "length_gain",
    "split_sentences",
    "sentence_alignment",
    "sentence_alignment_rows",
    "lexicon_rewrite",
    "term_usage",
    "notation_preserved",
    "final_answer_kept",
    "rewrite_report",
    "pair_corpora",
    "render_chat",
    "generation_prompt",
    "collect_messages",
    "turn_pairs",
    "session_segments",
    "clean_reply",
    "history_preview",
    "think_counts",
    "think_balanced",
    "think_spans",
    "pick_text_field",
    "think_stats",
    "think_stats_by",
    "split_response",
    "close_think",
    "max_think_length",
    "coverage_gate",
    "format_gate",
    "tags_after_truncation",
    "keep_essential",
    "token_diff",
    "add_special_tokens",
    "token_audit",
    "strip_tokens",
    "tokenize",
    "build_vocab",
    "encode",
    "labels",
    "pad_batch",
    "epoch_plan",
    "padding_waste",
    "length_profile",
    "stream_prepare",
    "chunk_assembly",
    "stream_sessions",
    "stream_stats",
)

QUERIES = {k: _QUERIES[k] for k in ORDER if k in _QUERIES}
QUERIES.update({k: v for k, v in _QUERIES.items() if k not in QUERIES})
ORACLE = {k: _ORACLE[k] for k in QUERIES if k in _ORACLE}
