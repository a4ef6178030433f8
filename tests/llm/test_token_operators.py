import zlib

import numpy as np
import public_tokenizers as P
from colloquy.llm import packing, token_files, tokens
from colloquy.llm.common import scratch
from tokenizers import Tokenizer

ODD = [
    "a  b", " lead", "trail ", "a \n b", "a\n  b", "x\t y", "\n\n\n", "", " ", "   ", "it's you're", "naïve café 123abc!!..", "a b   c",
    "İstanbul ŞŞ ﬁ", "<|endoftext|> x <|startoftext|>", "日本語 テスト", "é x́", "A" * 3000, "don't.", "word,word", "x\x1cy \x85z",
    "a\r\nb \r\n c", "😀 😀😀  👩‍👩‍👧", "ÀÉß ÷ × ẞ", "and.\nEr it_ __ _x",
]


def plain_ids(name, text):
    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    return tok.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        got = tokens.Ids(P.path(name)).encode(ODD)
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [plain_ids(name, t) for t in ODD]


def test_cache_rolls_over_without_changing_ids():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    cache = tokens.PieceCache(tok, " ", False, capacity=3)
    words = ["alpha", "beta", "gamma", "delta", "alpha", "eps", "beta", "x" * 60]
    got = [np.frombuffer(cache[w], np.uint32).tolist() for w in words]
    assert got == [plain_ids("byte_bpe_50k.json", " " + w) for w in words] and len(cache) <= 3


def check_pack(rows, texts):
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append([*plain_ids("byte_bpe_50k.json", t or ""), 0])
    for r in rows:
        known = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32 for x in known)
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
        padded += bool(at & (at - 1))
    return padded, len(windows)


def test_pack_covers_every_id_once(spark, docs_of):
    texts = [(i, f"word{i} " * (i * 37 % 900)) for i in range(60)] + [(60, None), (61, ""), (None, "no id"), (7, "same id again"), (62, "long " * 40_000)]
    rows = packing.pack(docs_of(texts).repartition(3), P.path("byte_bpe_50k.json")).collect()
    padded, windows = check_pack(rows, texts)
    assert padded <= 3 and windows > 40


def test_pack_of_nothing(docs_of):
    assert packing.pack(docs_of([]), P.path("byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(spark, docs_of):
    texts = [(i, f"Text {i} of é words " * (i % 13)) for i in range(50)] + [(50, None), (None, "null id"), (5, "same id"), (51, "long " * 30_000)]
    path = scratch(spark, "test-tokens")
    token_files.write_tokens(docs_of(texts), path, P.path("word_bpe_49k.json"), 2)
    rows = token_files.read_tokens(spark, path).collect()
    assert len(rows) == len(texts)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows][0] is None and [r.doc_id for r in rows][1:] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    have = sorted([*plain_ids("word_bpe_49k.json", t or ""), 2] for _, t in texts)
    assert sorted(list(r.ids) for r in rows) == have
    digests = {(r.start, r.ids_crc32) for r in token_files.id_digests(token_files.read_tokens(spark, path)).collect()}
    assert digests == {(r.start, zlib.crc32(np.array(r.ids, np.uint32).tobytes())) for r in rows}
    plan = token_files.read_tokens(spark, path).where("doc_id = 3").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id,3)" in plan and "ids:array" not in plan.split("ReadSchema")[-1]


def test_token_files_of_nothing(spark, docs_of):
    path = scratch(spark, "test-none")
    token_files.write_tokens(docs_of([]), path, P.path("word_bpe_49k.json"), 2)
    assert token_files.read_tokens(spark, path).count() == 0
