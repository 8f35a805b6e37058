"""Recursive byte-pair encoding against the tiktoken library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import duck_bpe
from test_llm_spark import SCHEMA, made_rows

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def plain(name):
    ranks = duck_bpe.read_ranks(P.path(name))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("name", FILES)
def test_ids_and_bytes_equal_the_library(name):
    ours, want, rng = duck_bpe.DuckBpe(duck_bpe.read_ranks(P.path(name)), P.PATTERN), plain(name), random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "12", "!", ",", "|", "<|endoftext|>", "ß", "Σ"]
    parts += ["\u0301", "中", "\u3000", "\u2028", "İ", "'LL", "word,", "\x00", "-----", "aaaa", "😀", "\u200b", "²", "Ⅷ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    # long words: repetitions, touching pairs and letters at random
    texts += ["-" * 5000, "ab" * 3000, "é" * 700, " " * 3001, "a" * 64, "a" * 65, "".join(rng.choice("abcdefg") for _ in range(1500)), ""]
    got = ours.encode(texts)
    for text, raw in zip(texts, got, strict=True):
        assert ids_of(raw) == want.encode_ordinary(text), repr(text)
    assert ours.decode(got) == [t.encode() for t in texts]


def test_both_recursions_agree():
    ours, rng = duck_bpe.DuckBpe(duck_bpe.read_ranks(P.path(FILES[0])), P.PATTERN), random.Random(2)
    words = ["".join(rng.choice("aabbc -=") for _ in range(rng.randint(2, 60))).encode() for _ in range(400)]
    assert ours.contract(words, ours.short) == ours.contract(words, ours.long)


def test_one_pair_at_a_time_where_a_made_token_has_an_earlier_pair():
    # "xy" is made at 257 though "xyx" is 256: the second "xy" must wait for it
    ranks = {bytes([b]): b for b in range(256)} | {b"xyx": 256, b"xy": 257, b"zz": 258}
    ours = duck_bpe.DuckBpe(ranks, P.PATTERN)
    want = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in ("xyxy", "xyxyxyx", "zzzzz", "xyzzxyx"):
        assert ids_of(ours.encode([word])[0]) == want.encode_ordinary(word)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(duck_bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(duck_bpe, "BLOCK_BYTES", 20)
    ours, want = duck_bpe.DuckBpe(duck_bpe.read_ranks(P.path(FILES[0])), P.PATTERN), plain(FILES[0])
    for text in ("onerlyon enverieach anderheb", "anderheb losastat onerlyon", "", "onerlyon"):
        assert ids_of(ours.encode([text])[0]) == want.encode_ordinary(text)


def test_unknown_ids_are_refused():
    ours = duck_bpe.DuckBpe(duck_bpe.read_ranks(P.path(FILES[0])), P.PATTERN)
    with pytest.raises(ValueError, match="not in the vocabulary"):
        ours.decode([np.array([50256], "<u4").tobytes()])
    assert ours.decode([]) == [] and ours.decode([b""]) == [b""]


def test_operators_over_awkward_rows(spark):
    rows, want, path = made_rows(), plain(FILES[0]), P.path(FILES[0])
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS ids", "0 AS n_tokens", "'y' AS bytes").repartition(3)
    expected = Counter()
    for i, text, *_ in rows:
        ids = want.encode_ordinary(text or "")
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        expected[(i, len(ids), *digests)] += 1
    got = duck_bpe.round_trip(docs, path, P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == expected
    ids = duck_bpe.encode(docs, path, P.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((i, tuple(want.encode_ordinary(t or ""))) for i, t, *_ in rows)
    back = duck_bpe.decode(ids, path, P.PATTERN)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    assert duck_bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0
