import base64
import random

import numpy as np
import pytest

from helixmill.llm.bpe import Bpe, TextBpe
from helixmill.llm.packing import Encoder, cut, pack
from helixmill.llm.quality_rules import measures, neighbour_lcps, suffix_ranks
from helixmill.llm.words import head_and_chunks, spaced_chunks

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "é  ü   z", "it's we'll\tx", "漢字 かな 🙂🙂  9 99,9", "\x1c \x1d x", "end  ", "<|endoftext|> x", "a" * 300, " \u0085 b  c", "ﬀ K İ ı", "﻿ x ​ y"]


def texts():
    rng = random.Random(5)
    pool = "ab c'sé 漢\n\t  1.,🙂  ß"
    return ODD + ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(400)]


def test_bpe_is_tiktoken():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = TextBpe(path, P.PATTERN, most=50)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts():
        ids = enc.encode_ordinary(t)
        assert own.ids(t) == ids, t
        parts = own.parts(t)
        assert b",".join(p[0] for p in parts) == ",".join(map(str, ids)).encode()
        assert b"".join(p[2] for p in parts).decode() == t and sum(p[1] for p in parts) == len(ids)


def test_bpe_merges_each_token_once_and_finds_matches_in_runs():
    """New chunks share one search for matches, and pairs of tokens are judged without merging their bytes anew."""
    own, calls = TextBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), {"matches": 0, "merged": 0}

    def counted(name, f):
        def run(*a):
            calls[name] += 1
            return f(*a)

        return run

    own.matches, own.bpe.merged = counted("matches", own.matches), counted("merged", own.bpe.merged)
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdeéß", k=9)) + "." for _ in range(2000))
    parts = own.parts(text)
    assert b"".join(p[2] for p in parts).decode() == text
    assert calls["matches"] <= 8 and calls["merged"] == 0 and len(own.bpe.agree) > 1000


def test_neighbours_are_what_merges_leave():
    """Also with ranks that no merges give: tokens out of reach, and merges out of order."""
    rng = random.Random(6)
    for sort in (True, False):
        for _ in range(60):
            words = {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(25)}
            ranks = {b: i for i, b in enumerate([b"a", b"b", b"c", *(sorted(words, key=len) if sort else words)])}
            bpe = Bpe(ranks)
            for a in ranks:
                n = next((n for n in range(len(a) - 1, 0, -1) if a[:n] in ranks), 0)
                assert bpe.shorter[ranks[a]] == (ranks[a[:n]] if n else -1)
                for b in ranks:
                    assert bpe.compatible(ranks[a], ranks[b]) == (bpe.merged(a + b) == [ranks[a], ranks[b]]), (a, b, ranks)


def test_empty_texts_have_no_ids():
    own = TextBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert own.written(["", ""]) == [(b"", 0, b"")] * 2 and own.written(["", "a", ""])[1][1:] == (1, b"a")


def test_chunked_encoding_is_the_tokenizers():
    from tokenizers import Tokenizer

    own, plain = Encoder(P.path("byte_bpe_50k.json"), most=50), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    many = [*texts(), "a b<|endoftext|> c d", "<|endoftext|><|endoftext|>x  y <|endoftext|>", "x <|endof text|> y"]
    assert [x.tolist() for x in own.many(many)] == [plain.encode(t, add_special_tokens=False).ids for t in many]
    for t in many:
        assert "".join(spaced_chunks(t)) == t
        head, rest = head_and_chunks(t)
        assert [*([head] if head else []), *(" " + x for x in rest)] == spaced_chunks(t)
        assert own.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_pieces_of_chunks_encode_as_in_the_text():
    from tokenizers import Tokenizer

    own, plain, rng = Encoder(P.path("byte_bpe_50k.json"), most=3000), Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(5)
    signs = ["  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u0085", "\u180e", "\x1c", "\x00", "\x7f", "'s", "'", "\u2019t", "\u201c", "\u00d7", "\u00f7", "\u00aa", "\u00b2", "\u0301", "\u0660", "\u4e2d\u6587", "\U0001f600", "\u03b1"]
    signs += ["the", "And", "\u00e9t\u00e9", "\u017ftra\u00dfe", "\u0434\u043e\u043c", "x1y22", ".", ",", "?!", "#%", "_", "'ll", "<|", "<|endoftext|>"]
    for _ in range(150):
        many = ["".join(rng.choice(signs) if rng.random() < 0.5 else rng.choice([" ", " the", ".", "\n", " 12", " Re"]) for _ in range(rng.randrange(12))) for _ in range(8)]
        assert [x.tolist() for x in own.many(many)] == [plain.encode(t, add_special_tokens=False).ids for t in many], many
    long = " ".join(rng.choices(signs, k=3000)).replace("<|endoftext|>", "") + "x" * 1000
    Encoder.PLACED, before = 100, Encoder.PLACED
    try:
        assert own.ids(long).tolist() == plain.encode(long, add_special_tokens=False).ids
    finally:
        Encoder.PLACED = before


def test_words_are_encoded_once_whatever_signs_follow():
    own, sent = Encoder(P.path("byte_bpe_50k.json")), []

    class Counted:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return self.of.encode_batch_fast(texts, **more)

        def tokenize(self, text):
            sent.append(text)
            return self.of.tokenize(text)

    words = [a + b for a in ("thorre", "ciónes", "lyouble") for b in "abcdefgh"]
    text = " ".join(w + s + v for w in words for v in ("", "\nThe") for s in (".", ",", "?!", "###", ""))
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    own.tokenizer, own.model = Counted(own.tokenizer), Counted(getattr(own, "model", None))
    assert own.ids(text).tolist() == want and own.ids(text).tolist() == want
    assert sum(map(len, sent)) < 2 * sum(map(len, words))  # the text has 13 times as many characters


def test_pack_fits_and_fills():
    rng = random.Random(1)
    for cap in (7, 100, 2048):
        lengths = sorted((rng.randrange(1, cap + 1) if rng.random() < 0.4 else rng.randrange(1, cap // 3 + 1) for _ in range(500)), reverse=True)
        places = pack(lengths, cap)
        bins: dict[int, list] = {}
        for n, (b, o) in zip(lengths, places):
            bins.setdefault(b, []).append((o, n))
        for rows in bins.values():
            rows.sort()
            assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]
            assert sum(n for _, n in rows) <= cap
        assert len(bins) <= 1.05 * sum(lengths) / cap + 2 or cap == 7
    assert cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and cut(2048, 2048) == [(0, 2048)]


def brute(words, least=8):
    n = len(words)
    covered, longest = set(), 0
    at: dict[tuple, list] = {}
    for i in range(n - least + 1):
        at.setdefault(tuple(words[i : i + least]), []).append(i)
    for starts in at.values():
        if len(starts) > 1:
            covered |= {i + j for i in starts for j in range(least)}
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    return len(covered), longest


def test_suffix_repeats_are_brute_force():
    rng = random.Random(2)
    docs = ["", "one", "a b " * 30, " ".join(rng.choices("xyz", k=60))] + [" ".join(rng.choices("abcdefgh", k=25) * rng.randrange(1, 3)) for _ in range(12)]
    got = measures(docs, 8)
    for t, (n, chars, _, _, covered, longest) in zip(docs, got):
        w = t.split()
        assert (n, chars) == (len(w), sum(map(len, w)))
        assert (covered, longest) == brute(w), t
    a = np.array([3, 1, 3, 1, 3, 0])
    order, lcp = neighbour_lcps(suffix_ranks(a))
    assert order.tolist() == sorted(range(6), key=lambda i: a[i:].tolist()) and lcp.tolist() == [0, 0, 2, 0, 1, 3]


def test_quality_lines_and_symbols():
    ((n, chars, symbols, dups, *_),) = measures(["é#*\n \nx y\nx y\nx y \n\n"])
    assert (n, chars, symbols, dups) == (7, 9, 2, 1)
