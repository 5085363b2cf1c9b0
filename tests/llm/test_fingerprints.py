import hashlib
import random
import re

from rasterloom.llm import fingerprints as P


def test_query(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdeéghi") for _ in range(r.randint(2, 9))) for _ in range(900)]
    rows = [(3 * d, " ".join(r.choice(vocab) for _ in range(r.randint(0, 300)))) for d in range(150)] + [(1000, None), (1001, "é"), (1002, ""), (1003, "x y z w")]
    order = sorted(rows)
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in P.fingerprint_edits(df).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        x = got[d]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        f, g, h = (P.fingerprints_of([y.encode()])[0] for y in (t, e, n))
        assert (x["fingerprint"], x["edited_fingerprint"]) == (f.hex(), g.hex())
        assert x["near_edited"] == P.likeness(f, g) and x["near_next"] == P.likeness(f, h)
    long = [x for x in got.values() if x["n_chars"] > 400 and x["doc_id"] < 440]
    assert min(x["near_edited"] for x in long) > 0.4 and max(x["near_next"] for x in long) < 0.4


def test_near_finds_all(spark):
    r = random.Random(3)
    fps = []
    for _ in range(30):
        c = r.getrandbits(P.BITS)
        for _ in range(6):
            x = c
            for b in r.sample(range(P.BITS), r.randint(0, 5)):
                x ^= 1 << b
            fps.append(f"{x:0{P.BITS // 4}x}")
    df = spark.createDataFrame([(f,) for f in fps], "fp string")
    for radius, spare in ((1, 1), (3, 1), (3, 2), (6, 2)):
        want = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in set(fps) for b in set(fps) if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= radius}
        for pairs in (64, 1):  # all fronts few, all fronts hot
            assert {(x["a"], x["b"]): x["apart"] for x in P.near(df, radius, spare=spare, pairs=pairs).collect()} == want
    one = df.limit(1)
    assert P.near(df, 6, one).count() == sum(fps[0] in p for p in want)


def test_links(spark):
    """How many documents lie within the radius, against brute force; a third of them exact copies, and hot fronts."""
    r = random.Random(4)
    c = r.getrandbits(P.BITS)
    fps = [f"{c:064x}"] * 40 + [f"{c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))):064x}" for _ in range(120)] + [f"{r.getrandbits(P.BITS):064x}" for _ in range(40)]
    rows = [(10 * d, f) for d, f in enumerate(fps)] + [(None, fps[0])]
    got = {x["doc_id"]: x["n_near"] for x in P.with_links(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    for d, f in rows:
        want = sum((int(f, 16) ^ int(g, 16)).bit_count() <= P.RADIUS for _, g in rows) - 1
        assert got[d] == (want if d is not None and d % 100 == 0 else None)


def brute_fingerprint(text):
    """The weighted vote by Python's integers, word by word."""
    words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    big, odd = 1 << 64, 0xD6E8FEB86659FD93

    def mix(x):
        x = (x ^ x >> 32) * odd % big
        x = (x ^ x >> 32) * odd % big
        return x ^ x >> 32

    def name(w):
        h = mix((len(w) * 0x9E3779B97F4A7C15 + 0xA24BAED4963EE407) % big)
        for i in range(0, len(w), 8):
            h = mix(h ^ mix((int.from_bytes(w[i : i + 8], "little") + i) * 0x9E3779B97F4A7C15 % big))
        return h

    h = [name(w) for w in words]
    terms = [(x, min(len(w) / 8, 1.5) ** 2) for x, w in zip(h, words)] + [(mix((x * 0xC2B2AE3D27D4EB4F + y) % big), 1.0) for x, y in zip(h, h[1:])]
    out = 0
    for bit in range(P.BITS):
        salt = 0x9E3779B97F4A7C15 * (2 * (bit // 64) + 1) % big
        if sum(w if mix((x + salt) % big) >> bit % 64 & 1 else -w for x, w in terms) > 0:
            out |= 1 << bit
    return out.to_bytes(P.BITS // 8, "little")


def test_vote():
    r = random.Random(6)
    for n in (0, 1, 2, 17, 80):
        t = " ".join("".join(r.choice("abcdéß日") for _ in range(r.randint(1, 14))) for _ in range(n))
        assert P.fingerprints_of([t.encode()])[0] == brute_fingerprint(t)
    assert P.likeness(bytes(32), bytes(32)) == 1.0 and P.likeness(bytes(32), b"\xff" * 32) == 0.0


def test_long_text(spark):
    t = " ".join(f"w{i % 977}" for i in range(200_000))
    got = P.fingerprint_edits(spark.createDataFrame([(1, t), (2, t + " end"), (3, "x y")], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["near_next"] > 0.9 for x in got} == {1: True, 2: False, 3: False}


def test_odd_tables(spark):
    rows = [(None, "a b c d e", 1), (1, "x", 2), (1, "x", 2), (1, "y y y y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_CHARS int")
    got = P.fingerprint_edits(df).collect()
    assert len(got) == 4 and all(len(x["fingerprint"]) == P.BITS // 4 for x in got)
    assert P.fingerprint_edits(df.limit(0)).count() == 0
    one = P.fingerprint_edits(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_a_third_equal(spark):
    """Rows equal in id and text, a third of the table: as brute force over all rows in order, and no task over three times the median."""
    r = random.Random(8)
    rows = [(d, " ".join(r.choice("alpha beta gamma delta epsilon".split()) for _ in range(r.randint(3, 30)))) for d in range(3000)]
    rows += [(700, rows[700][1])] * 1500 + [(900, rows[900][1])] * 2 + [(None, None)] * 3
    order = sorted(rows, key=lambda x: (x[0] is None, x[0]))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    out = P.fingerprint_edits(df)
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        want.append((d is None, d, hashlib.sha256(P.edited(t, n).encode()).hexdigest()))
    key = lambda x: (x[0], x[1] or 0, x[2])
    assert sorted([(x["doc_id"] is None, x["doc_id"], x["edited_sha256"]) for x in out.collect()], key=key) == sorted(want, key=key)
    many = spark.createDataFrame([(1, 200_000), (2, 3)], "doc_id long, times long")
    sizes = sorted(P._as_often(many).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
    assert sum(sizes) == 200_003 and sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_hot_fronts_either_way(spark, monkeypatch):
    """Fronts that a third of the fingerprints share: the same links whether the hot ones are broadcast or joined."""
    r = random.Random(9)
    c = r.getrandbits(P.BITS)
    fps = {f"{c ^ sum(1 << b for b in r.sample(range(96), r.randint(0, 3))):064x}" for _ in range(150)} | {f"{r.getrandbits(P.BITS):064x}" for _ in range(300)}
    df = spark.createDataFrame([(f,) for f in fps], "fp string")
    want = {(a, b) for a in fps for b in fps if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    for most in (1 << 16, 0):
        monkeypatch.setattr(P, "FRONTS", most)
        assert {(x["a"], x["b"]) for x in P.near(df, 3, pairs=8).collect()} == want
