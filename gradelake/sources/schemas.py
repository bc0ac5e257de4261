"""Schemas of the service's tables."""

from __future__ import annotations

#: Columns and types as the service stores them.
TABLES: dict[str, str] = {
    "sources": "id string not null, url string, raw_url string, content_sha256 string, content_text string, fetched_at timestamp, listed_at timestamp, list_title string, list_language string",
    "quizzes": "id string not null, owner_sub string, source_id string, source_url string, topic string, language string, num_questions smallint, strategy_requested string, strategy_used string, critique boolean, refresh boolean, "
    "status string, error string, phase string, phase_step smallint, phase_total smallint, phase_detail string, phase_updated_at timestamp, idempotency_key string, request_hash string, created_at timestamp, updated_at timestamp",
    "generation_jobs": "id string not null, quiz_id string, attempt_no smallint, status string, model string, prompt_tokens int, completion_tokens int, cached_tokens int, cost_usd decimal(10,6), budget_state string, error string, "
    "started_at timestamp, finished_at timestamp, scored_at timestamp, scoring_attempts smallint, scoring_claimed_until timestamp",
    "questions": "id string not null, quiz_id string, position smallint, prompt string, type string, explanation string, source_quote string, difficulty string",
    "options": "id string not null, question_id string, position smallint, text string, is_correct boolean",
    "attempts": "id string not null, quiz_id string, user_sub string, status string, started_at timestamp, submitted_at timestamp, final_score decimal(7,5), scoring_version smallint, idempotency_key string, request_hash string",
    "answers": "id string not null, attempt_id string, question_id string, score decimal(6,5), weight decimal(8,6), answered_at timestamp, revision int",
    "answer_selections": "answer_id string, option_id string",
    "eval_scores": "id string not null, target_type string, target_id string, evaluator string, value decimal(6,4), reasoning string, meta string, created_at timestamp",
    "document_requests": "id string not null, url string, title string, description string, note string, requested_by string, status string, detector_score decimal(5,4), excerpt string, reviewed_by string, reviewed_at timestamp, review_note string, created_at timestamp",
}
