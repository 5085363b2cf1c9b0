import random

from test_substring_dedup import brute, texts

from rasterloom.llm.substring_dedup import substring_dedup


def test_repeated_rows_are_one_document(spark):
    """Rows equal in id and text, in several partitions: as brute force over the distinct rows, for every row."""
    rows = texts(3)
    want = brute(rows, 20)
    again = rows + rows[::2] + rows[::3]
    random.Random(3).shuffle(again)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(again)], "doc_id long, text string, at long").repartition(7)
    got = substring_dedup(df).collect()
    assert sorted(r["at"] for r in got) == list(range(len(again)))
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == {(d, *x) for d, x in want.items()}
