"""Every registered query of the text operators over the smallest tables."""

from collections import Counter

import pytest

from tidemark.llm import registry

COLUMNS = {
    "p7_ids": {"doc_id", "ids"}, "p7_offsets": {"doc_id", "starts", "ends"}, "p7_decoded": {"doc_id", "text"}, "p7_tokens_per_source": {"source", "n_documents", "n_tokens"},
    "p8_mix": {"doc_id", "source", "n_tokens", "copies"}, "p9_found": {"doc_id"}, "p9_scores": {"doc_id", "score", "abusive"}, "p9_rates": {"source", "n_documents", "n_abusive", "rate"},
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    import duckdb

    df = registry.QUERIES[name](spark, sf)
    got = df.collect()
    assert name not in COLUMNS or set(df.columns) == COLUMNS[name]
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    if name in ("p7_ids", "p7_offsets", "p7_decoded", "p9_scores"):
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in documents.select("doc_id").collect())
    if name == "p9_scores":
        assert all(-1 <= r.score <= 1 for r in got)
    if name in registry.SQL:
        con = duckdb.connect()
        for t in ("documents", "mix_targets"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        found = con.execute(registry.SQL[name])
        names = [c[0] for c in found.description]
        assert Counter(tuple(r[c] for c in names) for r in got) == Counter(found.fetchall())
