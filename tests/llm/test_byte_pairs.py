import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trendloom.llm.byte_pairs import TOKENIZERS, BytePairs, decode_ids, encode_texts

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")
PIECES = st.lists(st.sampled_from(["a", "the ", " we're", "'ll", "'", "l", "  ", "\n\n", "\t", " 12", "é", "，", "　", "漢字", "<|endoftext|>", "​", "👩‍💻", ".", "\x1f", "\x85"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def small():
    return BytePairs(RANKS, leaf_chars=5, window_chars=2)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_join_is_the_encoding_of_the_whole(small, a, b):
    plain = small.encoding.encode_ordinary
    assert small.join(a, small.leaf(a), b, small.leaf(b)) == plain(a + b)
    assert small.encode(a + b) == plain(a + b)
    assert small.decode(small.encode(a + b)) == a + b


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["From: a\n\nWe're   <|endoftext|> 12 \r\n", "  \n ", "é" * 9000, "word " * 5000, "漢" * 5000, " " * 9000, "x'll " * 3000]
    pairs = BytePairs(RANKS)
    assert [pairs.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


RUNS = st.lists(st.sampled_from(["hello", "ing", "漢字", "é" * 40, " " * 50, "aaaa", "zq", "Th", "the", "antidis", "'s", "'re", "'", "0", "12", "777", "===", "-", "/*", " ", "\n"]), min_size=1, max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(RUNS, RUNS, st.integers(0, 10**6))
def test_windows_inside_pieces(small, a, b, seed):
    rng = random.Random(seed)
    long = lambda: "".join(rng.choice(rng.choice(["abcdefgh", "theTHE", "0123456789", "=-/*#"])) for _ in range(80)) if rng.random() < 0.2 else "".join(rng.choice("etaoinshr") for _ in range(rng.randint(0, 300)))
    for left, right in ((a + long(), long() + b), (a, b)):
        assert small.join(left, small.leaf(left), right, small.leaf(right)) == small.leaf(left + right)


def test_every_token_is_its_own_encoding(small):
    """What the stability of neighbours rests on."""
    whole = set(small.token_bytes)
    assert all(small._piece(t) == [i] for i, t in small.token_bytes.items()) and len(whole) > 50_000
    ranks = {t: i for i, t in small.token_bytes.items()}

    def merged(piece: bytes) -> int:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((ranks.get(x + y, 10**9), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 10**9:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts)

    assert all(merged(t) == 1 for t in list(small.token_bytes.values())[::7])


def test_long_pieces_take_small_windows():
    pairs = BytePairs(RANKS)
    rng = random.Random(2)
    texts = {"letters": "".join(rng.choice("etaoinshrdlu") for _ in range(200_000)), "digits": "".join(rng.choice("0123456789") for _ in range(200_000)), "lines": "=" * 100_000}
    texts |= {"han": "漢字仮名" * 10_000, "blank": " " * 60_001, "blanks and word": "x" + " \n\t" * 20_000 + "word " + "\u3000" * 3_000 + "y", "signs and word": "=" * 50_000 + "a"}
    for name, text in texts.items():
        pairs.widest = 0
        assert pairs.encode(text) == pairs.encoding.encode_ordinary(text)
        assert name in ("lines", "blanks and word", "signs and word") or pairs.widest < 1_000
    rng = random.Random(3)
    base64_lines = "\r\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(4_000))
    pairs.widest = 0
    assert pairs.encode(base64_lines) == pairs.leaf(base64_lines) and pairs.widest < 1_000


def test_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "Hello world"), (4, "Hello world"), (None, "x"), (5, "long words " * 20_000)], "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    got = {}
    for r in encode_texts(df).collect():
        got.setdefault(r["doc_id"], r["ids"])
    assert got[1] == [] and got[2] == [] and got[3] != [] and got[4] == [15496, 995]
    assert encode_texts(df).count() == 7 and encode_texts(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in decode_ids(encode_texts(df)).collect()}
    assert encode_texts(spark.createDataFrame([(1, " " * 3_000_000)], "doc_id bigint, text string")).selectExpr("size(ids) AS n").first()["n"] > 1_000
    assert back[5] == "long words " * 20_000 and back[1] == ""
