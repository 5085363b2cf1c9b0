import random

import numpy as np
import public_tokenizers as P
import tiktoken

from rasterloom.llm import bpe


def reference(name=bpe.RANKS):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(name)), special_tokens={})


def texts(seed, n):
    r = random.Random(seed)
    alphabets = ["abcdefghij ", "the of and ing tion ", "éèàü ßñ", "日本語テキスト", "0123456789 ", " \n\t\r\x0b 　", "!?.,;:'\"-#*", "🙂👍🏽", "ΑΒΓабв", "'s't're "]
    out = []
    for _ in range(n):
        a = r.choice(alphabets) + r.choice(alphabets)
        out.append("".join(r.choice(a) for _ in range(r.randint(0, 80))))
    return out


def test_same_as_tiktoken():
    for name in (bpe.RANKS, "byte_bpe_50k.tiktoken"):
        ref, own = reference(name), bpe.Encoder(P.path(name))
        for t in texts(7, 1500) + ["a" * 300, "ab" * 200, " " * 200, "<|endoftext|>"]:
            ids = np.frombuffer(own.encode(t), "<u4").tolist()
            assert ids == ref.encode_ordinary(t), t
            assert own.decode(own.encode(t)) == t


def test_stream():
    data = "aé日🙂".encode() * 3
    for size in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(data[i : i + size]) for i in range(0, len(data), size)) + s.close() == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe6\x97") == "a" and s.close() == "�"


def test_utf8_machine():
    """As Python's own decoder on any bytes, however they are cut."""
    r = random.Random(8)
    for _ in range(3000):
        data = b"".join(r.choice([bytes([r.randrange(256)]), r.choice("aé日🙂\u07ff\ud7ff\U0010ffff").encode(), r.choice([b"\xed\xa0\x80", b"\xf4\x90", b"\xe0\x80", b"\xf0\x9f\x98", b"\xc0\x80"])]) for _ in range(r.randint(0, 12)))
        s, out, i = bpe.Utf8Stream(), [], 0
        while i < len(data):
            j = i + r.randint(1, 5)
            out.append(s.feed(data[i:j]))
            i = j
        assert "".join(out) + s.close() == data.decode("utf-8", "replace"), data


def test_every_match_goes_through_the_transducer(monkeypatch):
    """One transition for each byte of every distinct match, tokens of the vocabulary among them."""
    own = bpe.Encoder(P.path(bpe.RANKS))
    seen = []
    plain = bpe.Transducer.encode
    monkeypatch.setattr(bpe.Transducer, "encode", lambda self, piece: seen.append(piece) or plain(self, piece))
    some = texts(11, 400) + ["the the and of"]
    for t in some:
        own.encode(t)
    assert sorted(seen) == sorted({m.encode() for t in some for m in own.find(t)}) and b" the" in seen
    t = own.known.transducer
    assert t.moves
    for piece in seen:
        state, key, out = 0, t.kept[0], []
        for byte in piece:
            key, ready = t._move(key, byte)
            out += ready
        assert plain(t, piece) == ([key[2]] if key[2] >= 0 else out + list(key[1][-1][1]))


def test_small_vocabularies(monkeypatch):
    """Against plain merging, with tokens that no merge builds, and states forgotten all the time."""
    r = random.Random(12)
    for _ in range(40):
        ranks = {bytes([b]): b for b in b"abc"}
        while len(ranks) < 12:
            word = b"".join(r.choice(sorted(ranks)) for _ in range(2))
            ranks.setdefault(word, len(ranks) + 200)
        ranks.setdefault(b"abcabcab", 900)  # found as a whole match only
        t = bpe.Transducer(ranks)
        monkeypatch.setattr(bpe, "_STATES", r.choice([1, 5, 1000]))
        for _ in range(200):
            piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 30)))
            assert t.encode(piece) == ([ranks[piece]] if piece in ranks else [ranks[x] for x in bpe.merge(ranks, piece)]), piece
        assert t.encode(b"abcabcab") == [ranks[b"abcabcab"]]


def test_frame(spark):
    rows = [(None, "x y", 1), (1, None, 2), (1, "", 3), (1, "", 3), (2, "é" * 5000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    got = bpe.bpe_round_trip(df).collect()
    assert len(got) == 5 and all(x["decoded"] == (x["text"] or "") for x in got)
    assert bpe.bpe_round_trip(df.limit(0)).count() == 0


def test_pairs_against_merging():
    """The rule for neighbours agrees with merging their bytes."""
    t = bpe.Transducer(bpe.load_ranks(P.path(bpe.RANKS)))
    r = random.Random(5)
    ids = [i for i in r.sample(sorted(t.bytes_of), 1500) if t._fits(-1, i)] + list(range(97, 123))
    for _ in range(6000):
        a, b = r.choice(ids), r.choice(ids)
        x, y = t.bytes_of[a], t.bytes_of[b]
        assert t._fits(a, b) == (bpe.merge(t.ranks, x + y) == [x, y])
