import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from rasterloom.llm.packing import pieces  # noqa: E402
from rasterloom.llm.quality_rules import quality_rules  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_simhash_dedup import brute_components, brute_fp  # noqa: E402
from test_substring_dedup import brute as brute_substrings  # noqa: E402


def corpus():
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    docs = []
    for d in range(90):
        w = [r.choice(vocab) for _ in range(r.randint(60, 200))]
        lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
        if d % 3 == 0:
            lines.insert(1, passage)
        if d % 4 == 0:
            lines.append("All rights reserved.")
        docs.append((d, "\n".join(lines)))
    docs += [(100 + d, docs[d][1] + " end") for d in range(10)]
    docs += [(200 + d, "bad bad bad " * 60) for d in range(8)] + [(300, None), (301, "")]
    return docs


def test_against_brute_force(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {x["doc_id"] for x in quality_rules(df).filter("kept").select("doc_id").collect()}
    rows = [(d, t) for d, t in docs if d in kept]
    assert len(rows) == 100
    rows = [(d, x[2] if x[1] else t) for (d, t), x in zip(rows, (brute_lines(rows, 10)[d] for d, _ in rows))]
    first = brute_components([(d, brute_fp(t)) for d, t in rows])
    rows = [(d, t) for d, t in rows if first[d] == d]
    cut = brute_substrings(rows, 20)
    rows = [(d, cut[d][2] if cut[d][1] else t) for d, t in rows]
    assert len(rows) < 100 and sum(x[1] for x in cut.values()) > 300
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, x in rows:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes()
        want += [(d, s, n, zlib.crc32(ids[4 * s : 4 * s + 4 * n])) for s, n in pieces(len(ids) // 4)]
    assert sorted(want) == sorted(tuple(x)[:4] for x in got)


def test_stages_keep_columns(spark, tmp_path):
    """Columns named like any stage's own come through with their values."""
    docs = corpus()[:40]
    names = ["kept_text", "n_lines", "N_DROPPED", "n_words", "n_removed", "kept", "fp", "spans", "first", "drops", "pos"]
    rows = [(d, t, "en", *(d * 100 + k for k in range(len(names)))) for d, t in docs]
    df = spark.createDataFrame(rows + [(None, docs[0][1], "de", *range(len(names))), (3, docs[3][1], "en", *(300 + k for k in range(len(names))))], "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) > 20
        for r in got:
            assert [r[n] for n in names] == [(r["doc_id"] or 0) * 100 + k for k in range(len(names))]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def odd_rows():
    """Null, empty, blank and very long texts, a null id, and rows equal in id and text that differ in their extra column."""
    r = random.Random(12)
    vocab = [f"term{i}" for i in range(5000)]
    w = [r.choice(vocab) for _ in range(120_000)]
    w[70_000:70_050] = w[100:150]
    long = "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11))
    some = " ".join(r.choice(vocab) for _ in range(90))
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, long + " end"), (6, some), (6, some), (6, some), (7, "\n".join([some, "x", "x"])), (None, some[::-1]), (None, None)]


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd_rows()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), k) for k, (d, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, row int").repartition(3)
    run = dict(corpus_pipeline.STAGES)
    got = {name: {x["row"]: x for x in run[name](spark, df, str(tmp_path)).collect()} for name, _ in corpus_pipeline.STAGES[:-1]}
    for name, rows in got.items():
        for k, x in rows.items():  # a row that stays is one row as it came, but for its text
            assert x["doc_id"] == docs[k][0] and (x["text"] == docs[k][1] or name in ("line dedup", "substring dedup"))
    assert not {0, 1, 2, 10} & set(got["quality rules"])  # under 50 words
    assert all(x["text"] == docs[k][1] for k, x in got["line dedup"].items()) and len(got["line dedup"]) == len(docs)  # no line is in ten documents
    near = got["SimHash near-dedup"]
    texts = [t for _, t in docs]
    order = sorted({(d is None, d or 0, k if d is None else 0) for k, (d, _) in enumerate(docs)})
    assert len(near) <= len(order) and sum(k in near for k in (5, 6, 7)) == 1 and 3 in near and 4 not in near
    assert sum(not (texts[k] or "").split() for k in near) == 1 and 0 in near  # wordless texts are one component
    cut = got["substring dedup"]
    assert len(cut) == len(docs)
    first = [(d, t) for k, (d, t) in enumerate(docs) if k not in (6, 7) and d is not None]  # rows equal in id and text are one document
    want = brute_substrings(first, 20)
    for k, x in cut.items():
        if x["doc_id"] is not None:
            n, gone, kept = want[x["doc_id"]][:3]
            assert x["text"] == (kept if gone else docs[k][1]) and x["n_chars"] == len(x["text"] or "")
    packed = run["packing"](spark, df.drop("row"), str(tmp_path)).collect()
    tokens = {}
    for x in packed:
        tokens.setdefault(x["doc_id"], []).append((x["length"], x["doc_tokens"]))
    for d, ps in tokens.items():
        if d not in (6, None):
            assert sum(n for n, _ in ps) == ps[0][1]
    assert set(tokens) == {d for d, _ in docs} and sum(n for n, _ in tokens[6]) == 3 * tokens[6][0][1]
