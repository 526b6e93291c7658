"""Columns of the user with the names of inner columns keep their values."""

from pyspark.sql import functions as F

from lacuna.llm import op08_pii as op8


def test_pseudonyms_leave_other_columns(spark):
    texts = ["Call 212-555-0147 or mail jo@example.com", "born 1984-02-29, card 4111 1111 1111 1111", None, "", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["_p", "_parts", "_new", "_p_____", "found", "col"]
    crowded = docs.select("*", *[(F.col("doc_id") * 10 + i).alias(c) for i, c in enumerate(names)])
    plain = {r["doc_id"]: (r["text"], r["n_items"]) for r in op8.pseudonymise(docs).collect()}
    got = op8.pseudonymise(crowded).collect()
    assert {r["doc_id"]: (r["text"], r["n_items"]) for r in got} == plain and sum(n for _, n in plain.values()) >= 4
    assert all(r[c] == r["doc_id"] * 10 + i for r in got for i, c in enumerate(names))
