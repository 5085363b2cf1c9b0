import itertools
import random
import re

import duckdb

from rasterloom.llm import filter_audit as A

KINDS = "doc_id long, text string, source string"


def brute(rows, marks):
    """Every order by itself, document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = {}
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t],
        }
        docs.setdefault(s or "", []).append(({x for x in fails if fails[x]}, *marks.get(i, (0, 0))))
    out = {}
    for part, all_ in docs.items():
        gone_by = {x: 0 for x in "ABCDE"}
        for order in itertools.permutations("ABCDE"):
            left = list(all_)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in all_)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in all_), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                gone_by[f] += len(gone)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(gone_by[f])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(spark, rows, labels, kinds=KINDS):
    masks = A.failure_masks(spark.createDataFrame(rows, kinds), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return A.interaction_audit(masks, labels={"good": "good_lost", "toxic": "toxic_lost"})


def test_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(90)]
    texts = [" ".join(r.sample(words, n)) for n in (10, 49, 50, 60, 80)] + [" ".join(r.choices(words[:20], k=n)) for n in (30, 70)]
    texts += [t.upper() for t in texts] + [t + " 50% & more" for t in texts] + ["", None, " \t\n", "\x0b\x0c\r", "É" * 30, "A" + "b" * 19, "AB" + "c" * 30, "x y " * 60]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(300)]
    rows += [(None, texts[0], "a"), (None, "no other", None), (5, rows[5][1], "b"), (5, "another of 5", "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    marks = {}
    for i, q, x in labels:
        if i is not None:
            was = marks.get(i, (0, 0))
            marks[i] = (max(was[0], int(q == 1)), max(was[1], int(x == 1)))
    want = brute(rows, marks)
    got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in COLUMNS] for x in audit(spark, rows, labels).collect()}
    assert set(want) == set(got) and len(want) == 3 * 600
    assert want == got


def test_parity_sums_invert_to_cells(spark):
    rows = [("p", m, int(m % 3 == 0)) for m in range(32) for _ in range(m * m % 7)]
    sums = A.parity_sums(spark.createDataFrame(rows, "part string, mask int, good int"), 5, ["good"])
    got = sums.selectExpr(f"{A.cells_of('s', 5)} as c", f"{A.cells_of('s_good', 5)} as g").first()
    assert got["c"] == [m * m % 7 for m in range(32)] and got["g"] == [m * m % 7 if m % 3 == 0 else 0 for m in range(32)]


def test_odd_tables(spark):
    assert audit(spark, [], []).count() == 0
    got = audit(spark, [(1, "a", "s", 3, "x")], [], KINDS + ", mask int, part string").collect()  # clashing names
    assert len(got) == 600 and {x["part"] for x in got} == {"s"} and all(x["removed"] == int(x["filter_order"][x["step"] - 1] == "A") for x in got)


def test_long_text(spark):
    got = audit(spark, [(1, "word " * 300_000, "s")], []).filter("filter_order = 'BACDE' and step = 1").first()
    assert got["removed"] == 1 and got["shapley"] == 120


def test_fewer_filters(spark):
    """Any filters and labels: here three."""
    df = spark.createDataFrame([("p", m) for m in (0, 1, 3, 7)], "part string, mask int")
    got = {(x["filter_order"], x["step"]): x for x in A.interaction_audit(df, "XYZ").collect()}
    assert len(got) == 18 and got["ZYX", 1]["removed"] == 1 and got["ZYX", 3]["removed"] == 1 and got["XYZ", 1]["removed"] == 3
    assert got["XYZ", 1]["shapley"] == 6 + 3 + 2


def test_sql_gives_the_same(spark, tmp_path):
    rows = [(1, "A b", "s"), (2, "A b", "t"), (3, None, None), (4, "x " * 80, "s")]
    con = duckdb.connect()
    con.execute("create table documents as select * from (values (1, 'A b', 's'), (2, 'A b', 't'), (3, null, null), (4, repeat('x ', 80), 's')) t(doc_id, text, source)")
    con.execute("create table labels as select 1 as doc_id, 1 as quality, 0 as toxic")
    rel = con.execute(A.SQL)
    names = [x[0] for x in rel.description]
    want = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in COLUMNS] for x in (dict(zip(names, row)) for row in rel.fetchall())}
    got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in COLUMNS] for x in audit(spark, rows, [(1, 1, 0)]).collect()}
    assert got == want
