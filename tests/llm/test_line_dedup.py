import random
from collections import defaultdict

from rasterloom.llm.line_dedup import line_dedup

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows, least):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))

    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(d)
    out = {}
    for d, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if not (key(y) and len(docs[key(y)]) >= least)]
        out[d] = (len(x), len(x) - len(kept), "\n".join(kept))
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    pool = [f"{'Line' if i % 2 else 'ÉLine'} {i}" for i in range(30)] + ["", " ", " "]
    rows = [(d, "\n".join(r.choice([" ", "", "\t"]) + r.choice([str.upper, str.lower, str])(r.choice(pool)) + r.choice(["\r", ""]) for _ in range(r.randint(0, 12)))) for d in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n")]
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_text"]) for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows, 10)
    assert got == want and sum(x[1] for x in want.values()) > 50


def test_odd_tables(spark):
    rows = [(None, "a\nb", 1)] + [(i, "A \nonly%d" % i, 2) for i in range(9)] + [(3, "A \nonly3", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int")
    got = line_dedup(df).collect()
    assert len(got) == 11 and all(x["n_dropped"] == 1 for x in got)
    assert line_dedup(df.limit(0)).count() == 0
