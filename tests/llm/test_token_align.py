"""Token alignment against plain Python with the tokenizer file's own library, byte by byte."""

import hashlib
import random
from collections import Counter

import pytest

from siltstone.llm import token_align as T
from tests.llm.cases import DOCS, documents

TEXTS = ["x", " lead", "trail ", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "é é Ａ ﬁ", "tab\tline\n\n  three   spaces", "你好 \U0001f600\U0001f600", "it's they'll 12345 a\x00b", " ", "  x"]


def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(T.BYTE_BPE), SentencePieceProcessor(model_file=T.PIECE_BPE)
    a.encode_special_tokens = True
    letter = T.byte_alphabet()
    spell_a = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return (lambda t: [(i, spell_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, spell_b(i)) for i in b.encode(t)])


def ranges(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(texts):
    encode_a, encode_b = sides()
    docs = []
    for text in texts:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x[1] for x in a) != whole or b"".join(x[1] for x in b) != whole:
            a, b = [], []
        a, b = ranges(a), ranges(b)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        parts = [";".join("|".join(",".join(str(t[2]) for t in side if low < t[1] <= high) for side in (a, b)) for low, high in zip([0, *ends], ends, strict=False))]
        docs.append((len(a), len(b), len(ends), links, parts[0]))
    counts = Counter(link for d in docs for link in d[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return [(a, b, g, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if a else "") for a, b, g, links, s in docs]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    letters = "abcdefg \t\n<|>é▁\U0001f600'12.,"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out = [(i, t, "en", "s", 0, None, None) for i, t in enumerate(TEXTS + made)] + documents()
    return [*out, (None, "no id", None, None, None, None, None), (None, "no id", None, None, None, None, None)]


@pytest.mark.parametrize(("head", "chunk"), [(T.HEAD, T.CHUNK), (40, 300), (0, T.CHUNK)])
def test_figures(spark, rows, head, chunk, monkeypatch):
    small = [r for r in rows if len(r[1] or "") < 3000]  # the plain form is quadratic in a text
    monkeypatch.setattr(T, "CHUNK", chunk)
    got = T.align_corpus(spark.createDataFrame(small, DOCS), head=head).collect()
    want = Counter((r[0], *x) for r, x in zip(small, brute([r[1] for r in small]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_links for r in got) > 5000


def test_links_and_groups_are_real(spark):
    row = T.align(spark.createDataFrame([(7, "Hello there")], "doc_id long, text string")).first()
    encode_a, encode_b = sides()
    n_b = len(T.side(T.PIECE_BPE).spelling)
    assert {divmod(x.pair, n_b) for x in row.links} <= {(a, b) for a, _ in encode_a("Hello there") for b, _ in encode_b("Hello there")}
    assert sum(x.n for x in row.links) == row.n_links and row.groups.count("|") == row.n_groups


def test_long_text_and_empty(spark):
    long = "".join(random.Random(1).choice("ab c\n") for _ in range(300_000))
    got = T.align_corpus(spark.createDataFrame([(1, long), (2, "z" * 200_000), (3, " " * 100_000)], "doc_id long, text string")).collect()
    a, b = sides()
    for r in got:
        text = {1: long, 2: "z" * 200_000, 3: " " * 100_000}[r.doc_id]
        assert (r.n_a, r.n_b) == (len(a(text)), len(b(text)))
        ends = {x[1] for x in ranges(a(text))} & {x[1] for x in ranges(b(text))}
        assert r.n_groups == len(ends) and r.n_links >= max(r.n_a, r.n_b)
    empty = T.align_corpus(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[-1] == "groups_sha256"


def test_split_equals_the_file(spark):
    """The merge ranks and the split give the same ids as the file's own library, for a character of every block."""
    encode_a, _ = sides()
    some = [chr(c) for c in range(0, 0x110000, 251) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}1{c} {c}{c}'s" for c in some]
    assert T.side(T.BYTE_BPE).encode(texts) == [[i for i, _ in encode_a(t)] for t in texts]
