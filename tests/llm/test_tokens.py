"""Ops 1, 8 and 9 against the tokenizers library on whole texts."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from arrears.llm import bpe_dp, common, packing, queries, token_store, tokens
from arrears.llm.tokens import ByteBpe, WordBpe, tokenizer_path
from tests.conftest import SMALL

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n\nb", "don't 'll x's", "ab\x1ccd\x85e\xa0f", "Σίσυφος ΣΑΣ",
       "e\u0301 \u0301x", "你好，世界 12٣²Ⅷ", "🙂‍👍🏽", "x<|endoftext|>y <|endoftext|> z<|startoftext|>", "\0\x0b\x0c", "İǅﬁ",
       "a" * 3000, "ab" * 2500 + " " + "?!" * 900, "word " * 4000]


@pytest.fixture(scope="module")
def whole():
    out = {}
    for path in (BYTE, WORD):
        tok = Tokenizer.from_file(path)
        tok.no_padding(), tok.no_truncation()
        out[path] = tok
    return out


def texts(n=400, seed=3):
    rng = random.Random(seed)
    parts = [*"ab eZ's \n\t\r,.!ñß你2²", "  ", "\n\n", " the", "ing", "'re", "<|endoftext|>", "\u2009", "\xa0", "\x1c", "\u0301", "🙂"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def ids_of(tok, text):
    return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()


def test_encoders_equal_the_library(whole):
    dp, lib, word = bpe_dp.PrefixBpe(BYTE), ByteBpe(BYTE), WordBpe(WORD)
    for t in texts():
        want = ids_of(whole[BYTE], t)
        assert dp.encode(t) == want == lib.encode(t), repr(t)
        assert dp.decode(want) == whole[BYTE].decode(array("I", want).tolist(), skip_special_tokens=False) == t
        assert word.encode(t) == ids_of(whole[WORD], t), repr(t)


def test_small_caches_change_nothing(whole):
    dp = bpe_dp.PrefixBpe(BYTE, cap=3)
    for t in texts(60, 4):
        assert dp.encode(t) == ids_of(whole[BYTE], t)


def test_decode_of_broken_bytes(whole):
    dp = bpe_dp.PrefixBpe(BYTE)
    for ids in ([0xF0], [100, 200], list(range(150, 260))):
        assert dp.decode(array("I", ids).tobytes()) == whole[BYTE].decode(ids, skip_special_tokens=False)


def odd_documents(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts(30))] + [(900, None, None, None), (900, None, None, None), (None, "null id", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long").repartition(3)


def test_op1_on_odd_rows_and_empty_table(spark, whole):
    docs = odd_documents(spark)
    got = bpe_dp.digests(docs, BYTE).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(ids_of(whole[BYTE], r.text or "")).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe_dp.digests(docs.limit(0), BYTE).count() == 0
    out = bpe_dp.encode_texts(docs.select("doc_id", "text"), BYTE).collect()
    assert all(r.ids is not None for r in out) and len(out) == docs.count()


def test_op1_query(spark, whole):
    docs = {r.doc_id: r.text for r in common.table(spark, SMALL, "documents").collect()}
    got = queries.op1_bpe_prefix_dp(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ids_of(whole[BYTE], docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def expected_store(tok, docs):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(tok, text or "") + array("I", [2]).tobytes()
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_op8_query(spark, whole):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    got = queries.op8_token_store(spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_store(whole[BYTE], docs)


def test_op8_odd_rows_and_access(spark, whole):
    docs = odd_documents(spark)
    got = token_store.round_trip(spark, docs, BYTE).collect()
    want = expected_store(whole[BYTE], [(r.doc_id, r.text) for r in docs.collect()])
    # rows of one doc_id may stand in either order
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), n, c) for d, _, n, c in want)
    assert sorted(r.start for r in got) == sorted(w[1] for w in want)
    assert token_store.round_trip(spark, docs.limit(0), BYTE).count() == 0
    uri = common.shared_path(spark, "t")
    files = [r.file for r in token_store.write_store(common.documents(docs), uri, BYTE, 2).collect()]
    found = [x for f in files if (x := token_store.StoreFile(uri, f).document(9)) is not None]
    assert len(found) == 1 and found[0].tobytes() == ids_of(whole[BYTE], ODD[9]) + array("I", [2]).tobytes()
    assert all(token_store.StoreFile(uri, f).document(12345) is None for f in files)


def check_packing(tok, docs, rows, capacity):
    pieces = defaultdict(list)
    for doc_id, text in docs:
        ids = ids_of(tok, text or "") + array("I", [1]).tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            p = ids[at:at + 4 * capacity]
            pieces[doc_id, k, at // 4, len(p) // 4].append(zlib.crc32(p))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length].append(r.ids_crc32)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == pieces
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_op9_query(spark, whole):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    used, least = check_packing(whole[WORD], docs, queries.op9_lp_packing(spark, SMALL).collect(), 4096)
    assert used <= least + 1


def test_op9_odd_rows(spark, whole):
    docs = odd_documents(spark)
    rows = packing.pack(spark, docs, WORD, capacity=50).collect()
    check_packing(whole[WORD], [(r.doc_id, r.text) for r in docs.collect()], rows, 50)
    assert packing.pack(spark, docs.limit(0), WORD).count() == 0


def test_plan_holds_every_piece_and_is_near_the_bound():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 4097, 3000), np.full(500, 4096), np.full(700, 1), rng.integers(1200, 2600, 4000), np.array([7])):
        lengths, counts = np.unique(sizes, return_counts=True)
        runs = packing.plan_runs(lengths, counts, 4096)
        held = defaultdict(int)
        for copies, content in runs:
            assert sum(n * t for n, t in content) <= 4096
            for n, t in content:
                held[n] += copies * t
        assert held == dict(zip(lengths.tolist(), counts.tolist()))
        used, least = sum(c for c, _ in runs), -(-int(sizes.sum()) // 4096)
        assert used <= max(least + 2, 1.04 * least)


def test_op8_dictionary_sample_is_of_the_whole_table(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'x' AS text")
    ids = [r.doc_id for r in token_store.sample(docs, 40_000).collect()]
    assert 800 < len(ids) <= 2 * token_store.SAMPLE_DOCS
    assert all(0.15 < sum(q <= i // 10_000 < q + 1 for i in ids) / len(ids) < 0.35 for q in range(4))
    assert token_store.sample(docs.limit(50), 50).count() == 50


def test_groups_equal_the_library_whatever_their_size_and_caches(whole, monkeypatch):
    found = [*texts(200, 7), "Hand, été!\nGroß́ \nline, x_y a'b", "naïve naïve, NAÏVE?! Ÿ\n\n end \n"]
    for kind, path in ((ByteBpe, BYTE), (WordBpe, WORD)):
        want = [ids_of(whole[path], t) for t in found]
        for size in (1, 100, 1 << 22):
            monkeypatch.setattr(tokens, "GROUP_BYTES", size)
            c = kind(path)
            c.words.cap, c.cache.cap, c.marks.cap = 9, 5, 3
            assert list(c.encode_all(pa.array([None, *found], pa.string()).slice(1))) == want
            c.at_edge[:] = False  # a vocabulary without marked edges: word by word
            assert list(c.encode_all(found)) == want


def test_new_words_of_a_group_go_to_the_library_in_one_call():
    c = WordBpe(WORD)
    model, calls = c.model, []

    class Counting:
        def encode(self, *args, **kwargs):
            calls.append("one")
            return model.encode(*args, **kwargs)

        def encode_batch_fast(self, *args, **kwargs):
            calls.append("many")
            return model.encode_batch_fast(*args, **kwargs)

    c.model = Counting()
    assert len(list(c.encode_all([f"Abc{chr(97 + k % 26)}{chr(97 + k // 26)}, ähn{chr(97 + k // 26)}" for k in range(500)]))) == 500
    assert calls == ["many"]


def test_grouped_batches_hold_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["x" * 50 * k])], names=["doc_id", "text"]) for k in range(9)]
    out = list(tokens.grouped(iter(batches), 300))
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == list(range(9)) and 1 < len(out) < 9
    assert list(tokens.grouped(iter([]))) == []
