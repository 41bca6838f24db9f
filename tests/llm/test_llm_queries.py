"""Registered queries on the small tables, with SQL where there is some."""

import oracle
import pytest

from helixframe.llm import queries

SF = f"{oracle.DATA}/sf0.001"
COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"], "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["conv_id", "turn", "reply_to", "branch"], "op4": ["doc_id", "bucket", "batch", "slot"],
    "op5": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op7": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def test_names():
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS)
    import __spark_entry__ as e
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    con = oracle.connect(SF)
    table = "embeddings" if name.startswith(("op1_", "op11_")) else "conversations" if name.startswith("op3") else "documents"
    assert len(rows) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0] or name.startswith("op12_") and rows
    if name in queries.SQL:
        rel = con.execute(queries.SQL[name])
        want = oracle.rows_of([d[0] for d in rel.description], rel.fetchall())
        assert oracle.rows_of(df.columns, [tuple(r) for r in rows]) == want
