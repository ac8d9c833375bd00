"""Queries of this subpackage. SQL can express what comes back, the counts and the bounds; not ids, mixes or scores."""

from tidemark.llm import abuse, mixing, tokenizer

QUERIES = {**tokenizer.QUERIES, **mixing.QUERIES, **abuse.QUERIES}
SQL: dict[str, str] = {
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p8_limits": "select source, max(target_share) as target_share, max(max_repeats) as max_repeats, true as within_cap, true as at_quota from mix_targets where source is not null group by 1",
    "p9_documents": "select source, count(*) as n_documents from documents group by 1",
}
