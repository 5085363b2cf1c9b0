import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from rasterloom.llm import packing as K


def test_pieces():
    for n in [*range(1, 70), 2047, 2048, 2049, 4096, 5000, 10_000]:
        got = K.pieces(n)
        assert sum(x for _, x in got) == n and [s for s, _ in got] == list(np.cumsum([0] + [x for _, x in got])[:-1])
        assert all(x & (x - 1) == 0 and x <= 2048 for _, x in got)


def test_against_tokenizer(spark):
    r = random.Random(1)
    words = ["Don't", "it's", "ÉTÉ", "straße.", "naïve,", "x×y", "İstanbul", "áb", "12ab", "...", "Ⅷ", "日本語", "e f", "\x1c", "the", "Über,", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "<|endoftext", "|>", "ﬁn", "ΣΑΣ", "ǅ", "q r"]
    rows = [(d, "".join(r.choice(words) + r.choice([" ", "\n", "  ", "\x0b"]) for _ in range(r.randint(0, 90)))) for d in range(60)] + [(70, None), (71, ""), (72, "word " * 5000), (None, "a b"), (3, "again")]
    got = K.pack(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, length int"), with_ids=True).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want += [(d, s, n, zlib.crc32(ids[4 * s : 4 * s + 4 * n]), len(ids) // 4) for s, n in K.pieces(len(ids) // 4)]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(map(key, want)) == sorted(key(x[:5]) for x in got)
    assert sorted(x["sequence_id"] for x in got) == list(range(len(got))) and all(x["offset"] == 0 and x["length"] <= 2048 for x in got)
    assert all(zlib.crc32(x["ids"]) == x["ids_crc32"] for x in got)
    assert [x["length"] for x in sorted(got, key=lambda x: x["sequence_id"])] == sorted((x["length"] for x in got), reverse=True)


def test_empty(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
