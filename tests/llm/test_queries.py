"""The text queries over the smallest tables."""

from pathlib import Path

import duckdb
import pytest
import tiktoken

from compare import normal
from tidemark.llm import queries, tokenize

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").df()


def test_ids(spark):
    with open(tokenize.VOCABULARY, "rb") as f:
        ranks = tokenize.PieceEncoder.from_bytes(f.read()).ranks
    public = tiktoken.Encoding("public", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table("documents")
    want = {int(d): public.encode_ordinary(t or "") for d, t in zip(docs.doc_id, docs.text.where(docs.text.notna(), None))}
    assert {r.doc_id: r.ids for r in queries.p8_ids(spark, DATA).collect()} == want
    counts = queries.p8_counts(spark, DATA).collect()
    assert sum(r.texts for r in counts) == len(docs) and sum(r.n_ids for r in counts) == sum(map(len, want.values()))


def test_leaks(spark):
    con = duckdb.connect()
    for name in ("documents", "eval_items"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    cur = con.execute(queries.ORACLES["p9_found"])
    want = normal(cur.fetchall(), [c[0] for c in cur.description])
    got = queries.p9_found(spark, DATA)
    assert normal(got.collect(), got.columns) == want and want
    reworded = {(r.doc_id, r.item_id) for r in queries.p9_reworded(spark, DATA).collect()}
    assert reworded


def test_personal_data_is_gone_after_redaction(spark):
    found = queries.p10_found(spark, DATA).collect()
    assert {r.pii_type for r in found} == {"email", "phone", "id_number", "address", "name"}
    redacted = {r.doc_id: r.text for r in queries.p10_redacted(spark, DATA).collect()}
    docs = table("documents")
    assert set(redacted) == set(docs.doc_id)
    for r in found:
        assert f"[{r.pii_type.upper()}]" in redacted[r.doc_id]
        assert r.pii_type == "name" or r.pii_text not in redacted[r.doc_id]
