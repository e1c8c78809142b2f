import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import bpe

PATH = bpe.default_path()
TEXTS = [
    "", "Hello, World! it's they'll 123 4.5", "  lead\ttab\nnew  ", "Grüße ÀÉ İstanbul ŠŽ", "ΣΑΣ ὈΔΥΣΣΕΎΣ",
    "é ñ Å ﬁ", "日本語 テスト 한국어 ㎏ Ⅷ ½ ²", "a\x1cb\x1fc\x85d\xa0e f​g", "😀👍🏽 x",
    "pre<|endoftext|>post <|startoftext|><|endoftext|>", "<|endoftext", "don't DON'T 'S 'tis rock'n'roll",
    "x" * 3000, "ab" * 500 + "é" * 200, "!!!???***$$$%%%&&&###", "\x00\x01 null", "ǅ ǆ ß ẞ ſ",
]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(text):
    t = library()
    ids = t.encode(text or "", add_special_tokens=False).ids
    decoded = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_same_ids_as_the_library():
    lib, enc = library(), bpe.Encoder(bpe.Tables(PATH), None)
    r = random.Random(1)
    spaces = [0x1C, 0x1F, 0x20, 0x20, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x200B]
    marks = [0x300, 0x301, 0x327, 0x3A3, 0x3A3, 0x130, 0x49, 0x27]
    texts = ["".join(chr(r.choice([*spaces, *marks, 0x41, 0xE9, 0x73, 0x30])) for _ in range(40)) for _ in range(2000)]
    chars = [chr(c) for c in [*range(0, 0x250), 0x301, 0x3A3, 0x3C2, 0x4E00, 0xAC00, 0x1F600, 0x2028, 0x3000, 0xFB01]]
    texts += TEXTS + ["".join(r.choice(chars) for _ in range(60)) for _ in range(300)]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        got, decoded = enc.both(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert decoded.decode() == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(5))
def test_automaton(seed):
    r = random.Random(seed)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(200)})
    arrays = bpe.build_automaton(words)
    ids = [[r.randrange(50_000) for _ in range(r.randint(0, 3))] for _ in words]
    arrays["ends"] = np.cumsum([len(x) for x in ids])
    arrays["ids"] = np.array([i for x in ids for i in x])
    lexicon = bpe.Lexicon(bpe.pack(arrays))
    for w, x in zip(words, ids, strict=True):
        assert np.frombuffer(lexicon.find(w), "<u4").tolist() == x
    for _ in range(300):
        w = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 7)))
        assert (lexicon.find(w) is not None) == (w in words)
    # Minimal: no two states have the same future.
    n, memo = len(arrays["final"]), []
    for s in range(n):
        arcs = range(arrays["first"][s], arrays["first"][s + 1])
        memo.append((bool(arrays["final"][s]), frozenset((int(arrays["label"][a]), memo[arrays["target"][a]]) for a in arcs)))
    assert len(set(memo)) == n


def test_rows(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, "same same", "", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = bpe.encode(df, PATH, ids=True)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(r.text) and len(r.ids) == r.n_tokens
    assert got.count() == len(rows) and bpe.encode(df.limit(0), PATH).count() == 0


def test_lexicon_changes_nothing(spark):
    words = "the of and thing <|endoftext|> Über naïve".split()
    r = random.Random(5)
    df = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(50))) for i in range(40)], "doc_id long, text string")
    a = bpe.encode(df, PATH, lexicon=bpe.build_lexicon(df, PATH, most=3), ids=False)
    b = bpe.encode(df, PATH, ids=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
