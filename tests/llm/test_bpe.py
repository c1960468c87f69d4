import hashlib

import public_tokenizers
import pytest

from slotwise.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CASES = ["", " ", "a", "don't stop", "  two  spaces\n\nlines\t", "été à Köln: 12345678 ½", "x" * 700, "ab" * 400 + " end", "日本語 のテキスト", "\u0085  x\x1c y", "the the the " * 30]


def brute(text):
    import regex

    out = []
    for piece in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [RANKS[p] for p in parts]
    return out


def test_codec_equals_brute_force_and_library():
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    codec = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(CASES, codec.encode(CASES)):
        assert ids == brute(text) == library.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_documents_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*CASES, None, "a"])] + [(None, "n", "y")], "doc_id bigint, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.round_trip(spark, docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate([*CASES, None, "a"]):
        ids = brute(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert rows[None].n_tokens == 1
    coded = bpe.encode_documents(spark, docs, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode_documents(spark, coded, RANKS, public_tokenizers.PATTERN).collect()}[3] == CASES[3]
    assert bpe.round_trip(spark, docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
