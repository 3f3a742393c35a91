"""Every registered query of the training-data operators: its columns, types and rows."""

import pytest

from meshweave.llm.queries import QUERIES

#: Columns that a query must have, and the table whose rows it has one of each.
CONTRACTS = {
    "op2": ("vec_id bigint, n_links bigint, component_id bigint, kept boolean", "embeddings"),
    "op3": ("doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "documents"),
    "op5": ("doc_id bigint, held_out boolean, score double, predicted int", "documents"),
    "op6": ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", "documents"),
    "op7": ("doc_id bigint, fingerprint string, component_id bigint", "documents"),
    "op8": ("doc_id bigint, size bigint, source_size bigint, target double, taken bigint", "documents"),
    "op9": ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", "documents"),
    "op10": ("page_id bigint, url string, text string, n_chars bigint", "pages"),
    "op1": ("doc_id bigint, ids array<int>", "documents"),
    "op4": ("page_id bigint, url string", None),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, sf_dir, name):
    columns, table = CONTRACTS[name.split("_")[0]]
    found = QUERIES[name](spark, sf_dir)
    types = dict(found.dtypes)
    assert all(types.get(c.split()[0]) == c.split()[1] for c in columns.split(", "))
    rows = found.count()
    assert rows > 0 and (table is None or rows == spark.read.parquet(f"{sf_dir}/{table}.parquet").count())
