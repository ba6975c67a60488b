"""Byte-level BPE against the library and against merging by definition."""

import base64
import random

import pytest
from helpers import corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.byte_bpe import ByteCodec, decode_bytes, default_ranks, encode_bytes, read_ranks
from sievework.llm.spm_codec import unpack_ids

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    path, pattern = default_ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    path, pattern = default_ranks()
    return ByteCodec(read_ranks(path), pattern)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abthe in'ers\n \t<|>x0 7A中文é😀\x1c\x85　"), st.characters(blacklist_categories=["Cs"])), max_size=80))
def test_equals_library(own, library, text):
    want = library.encode_ordinary(text)
    packed = own.encode_packed(text)
    assert unpack_ids(packed) == want and own.decode_packed(packed) == library.decode_bytes(want) == text.encode()


def test_awkward_texts(own, library):
    letters = "".join(random.Random(2).choice("abcdefghij") for _ in range(30_000))
    for text in ["", " ", " " * 999, "a" * 3000, "ab" * 2001, "中" * 1000, "\n" * 77 + "x", "it's we'LL I'd", letters, "<|endoftext|>", "é" * 300, "word " * 120_000]:
        assert unpack_ids(own.encode_packed(text)) == library.encode_ordinary(text)


def by_definition(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_joins_are_exact(own, seed):
    """Any cut of a byte string, joined in any order, gives its encoding, on a small
    vocabulary that makes changes run far to either side."""
    rnd = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    pool = [b"a", b"b", b"c"]
    for _ in range(rnd.randint(1, 12)):
        pool.append(rnd.choice(pool) + rnd.choice(pool))
    order = list(dict.fromkeys(t for t in pool if t not in tokens))
    rnd.shuffle(order)
    small = ByteCodec({t: i for i, t in enumerate(sorted(tokens) + order)}, ".+", rnd.choice([1, 1, 3]))
    data = bytes(rnd.choice(b"aaabc") for _ in range(rnd.choice([rnd.randint(1, 60), 150])))
    want = by_definition(small.ranks, data)
    assert small.merged(data) == want == small.reduced(data)
    cut = rnd.randint(0, len(data))
    assert small.joined(small.merged(data[:cut]), small.merged(data[cut:])) == want


def test_frame(spark, library):
    both = decode_bytes(encode_bytes(frame(spark), *default_ranks()), *default_ranks())
    got = both.collect()
    assert len(got) == len(corpus()) and {"key", "node", "score"} <= set(both.columns)
    for r in got:
        assert unpack_ids(r["ids_le"]) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert encode_bytes(frame(spark, []), *default_ranks()).count() == 0
    odd = spark.createDataFrame([(None, "x"), (bytearray(b"\xff\xff\xff\x7f"), "x")], "ids_le binary, decoded string")
    assert [bytes(r["decoded"]) for r in decode_bytes(odd, *default_ranks()).collect()] == [b"", b""]
