from test_substring_dedup import brute

from rasterloom.llm.substring_dedup import substring_dedup

#: Found by search: beside a0 to a7, in the same places, these words give a document the same first name.
ALIKE = "b1330 b110449 b16477 b109687 b65645 b65692 b10927 b56850".split()


def test_copies_have_two_names(spark):
    """Documents that share the first name only aren't copies; copies of either still are, also in stretches."""
    rest = [f"c{i}" for i in range(16)]  # fewer than a window
    a, b = (" ".join(x + rest) for x in ([f"a{i}" for i in range(8)], ALIKE))
    for rows in ([(1, a), (2, b)], [(1, a), (2, b), (3, a), (4, b), (5, a)]):
        for parts in (1, 3):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            for limit in (4 << 20, 60):
                got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df, limit=limit).collect()}
                assert got == brute(rows, 20)
