"""Token operators against the tokenizers library and naive code."""

import io
import struct
import zlib
from functools import lru_cache

import pytest

from odspark.llm import bpe, packing, token_store, unigram_count
from tests_llm_texts import messy_texts

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def tokenizer(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def library_ids(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path, spaces", [(WORD, "dropped"), (BYTE, "leading")])
def test_memo_encoder_equals_whole_text(path, spaces):
    from tokenizers import Tokenizer
    whole, enc = Tokenizer.from_file(path), bpe.MemoEncoder(path, spaces)
    for t in messy_texts(1, 300):
        want = whole.encode(t or "", add_special_tokens=False).ids
        got = enc.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want, repr(t)


def test_unigram_count_equals_library():
    from tokenizers import Tokenizer, normalizers
    from tokenizers.models import Unigram
    vocab = unigram_count.load_vocabulary(PIECES)
    t = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counter = unigram_count.UnigramCounter(vocab)
    for text in messy_texts(2, 300):
        assert counter.count(text or "") == len(t.encode(text or "", add_special_tokens=False).ids), repr(text)


def test_unigram_ties_and_bytes():
    """A tiny vocabulary with many equal scores; the library decides."""
    from tokenizers import Tokenizer, normalizers
    from tokenizers.models import Unigram
    import random
    vocab = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0),
             ("▁a", -3.0), ("bb", -1.0), ("▁▁", -4.0)]
    for full in (vocab, vocab + [(f"<0x{i:02X}>", -9.0) for i in range(256)]):
        t = Tokenizer(Unigram(full, unk_id=0, byte_fallback=len(full) > 99))
        t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        counter, r = unigram_count.UnigramCounter(full), random.Random(5)
        for _ in range(500):
            s = "".join(r.choice(["a", "b", " ", "é", "<unk>", "a", "b"]) for _ in range(r.randrange(14)))
            assert counter.count(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


def unigram_library(vocab):
    from tokenizers import Tokenizer, normalizers
    from tokenizers.models import Unigram
    t = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=len(vocab) > 256))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_unigram_fractional_scores():
    """Log probabilities of the 32k pieces: any score, not whole numbers only."""
    import math
    vocab = [(p, s if i < 3 else -math.log(i + 2.5)) for i, (p, s) in enumerate(unigram_count.load_vocabulary(PIECES))]
    counter, library = unigram_count.UnigramCounter(vocab), unigram_library(vocab)
    assert not counter.whole
    texts = [t or "" for t in messy_texts(12, 300)]
    for text in texts + [" ".join(texts), "x".join(texts).replace(" ", "")]:
        assert counter.count(text) == library(text), repr(text[:80])


def test_unigram_fractional_ties_follow_rounding():
    """Sums that are equal in exact numbers and differ by rounding: which path wins
    changes with the text before, so a remembered segment may not be reused."""
    import random
    vocab = [("<unk>", -0.7), ("▁", -0.1), ("a", -0.1), ("b", -0.2), ("c", -0.3), ("ab", -0.3), ("bc", -0.5), ("abc", -0.6),
             ("▁a", -0.2), ("▁ab", -0.4), ("ca", -0.4), ("bca", -0.6)]
    counter, library, r = unigram_count.UnigramCounter(vocab), unigram_library(vocab), random.Random(8)
    differ = set()
    for _ in range(400):
        s = "".join(r.choice("aabbcc  é") for _ in range(r.randrange(200)))
        assert counter.count(s) == library(s), repr(s)
        before = " ".join(["abc"] * r.randrange(60))
        differ.add(library(before + " abcabc") - library(before))
    assert len(differ) > 1  # the fixture reaches such choices
    assert counter.count("") == 0 and unigram_count.UnigramCounter([("<unk>", 0.0), ("▁", -0.5)]).count("zz") == 2
    with pytest.raises(ValueError):
        unigram_count.UnigramCounter([("<unk>", 0.0), ("▁", float("nan"))])


def test_unigram_long_text_without_spaces():
    vocab = unigram_count.load_vocabulary(PIECES)
    text = "".join(t or "" for t in messy_texts(13, 200)).replace(" ", "") * 5
    assert len(text) > 20_000
    assert unigram_count.UnigramCounter(vocab).count(text) == unigram_library(vocab)(text)


def test_count_tokens_frame(docs, empty_docs):
    texts = messy_texts(3, 40)
    counter = unigram_count.UnigramCounter(unigram_count.load_vocabulary(PIECES))
    got = {r.doc_id: r.n_tokens for r in unigram_count.count_tokens(docs(texts, clash=True), PIECES).collect()}
    assert got == {i: counter.count(t or "") for i, t in enumerate(texts)}
    assert unigram_count.count_tokens(empty_docs, PIECES).count() == 0


def store_rows(texts, end):
    start, out = 0, {}
    for i, t in enumerate(texts):
        ids = library_ids(WORD, t) + [end]
        out[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def test_store_round_trip(spark, docs, empty_docs):
    texts = messy_texts(4, 60)
    manifest = token_store.write_store(docs(texts, clash=True), token_store.new_folder(spark), WORD,
                                       bytes_per_file=8_000)
    assert manifest.count() > 2
    got = {r.doc_id: (r.start, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
           for r in token_store.read_store(manifest).collect()}
    want = store_rows(texts, 1)
    assert got == want
    some = spark.createDataFrame([(3,), (3,), (17,), (40,), (99999,)], "doc_id long")
    part = token_store.read_store(manifest, some).collect()
    assert {r.doc_id: r.start for r in part} == {k: want[k][0] for k in (3, 17, 40)} and len(part) == 3
    none = token_store.write_store(empty_docs, token_store.new_folder(spark), WORD)
    assert none.count() == 0 and token_store.read_store(none).count() == 0


def test_store_repeated_and_null_ids(spark):
    rows = [(5, "b"), (5, "a"), (None, "c"), (-7, None), (5, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_store.read_store(token_store.write_store(d, token_store.new_folder(spark), WORD)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, -7, 5, 5, 5]


def test_store_file_format():
    """Frames decode alone, bad bytes are noticed, only needed frames are read."""
    import numpy as np
    import zstandard
    out = io.BytesIO()
    w = token_store.StoreWriter(out, frame_bytes=400)
    ids = {k: np.arange(k, k * 30, dtype="<u4").tobytes() for k in range(1, 30)}
    for k, v in ids.items():
        w.add(k, v)
    w.close()
    raw = out.getvalue()
    r = token_store.StoreReader(io.BytesIO(raw), len(raw))
    assert {d: t.tobytes() for d, _, t in r.documents()} == ids
    r = token_store.StoreReader(io.BytesIO(raw), len(raw))
    assert [d for d, _, _ in r.documents({28})] == [28] and r.fetched == 1
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(ids.values())
    f = r.frames[3]
    bad = bytearray(raw)
    bad[int(f["offset"]) + int(f["stored"]) // 2] ^= 1
    with pytest.raises(Exception):
        token_store.StoreReader(io.BytesIO(bytes(bad)), len(bad)).frame(3)
    bad = bytearray(raw)
    bad[-60] ^= 1
    with pytest.raises(ValueError):
        token_store.StoreReader(io.BytesIO(bytes(bad)), len(bad))


def check_packing(rows, texts, ids_of):
    docs_seen, seqs = {}, {}
    for r in rows:
        docs_seen.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs_seen) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = ids_of(t) + [0], 0
        for r in sorted(docs_seen[i], key=lambda r: r.start):
            piece = ids[r.start:r.start + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids)) and len(piece) == r.length
            assert zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    fill = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        fill += at
    return fill, len(seqs)


def test_packing(docs, empty_docs):
    texts = messy_texts(6, 200) + ["tok " * 3000]
    rows = packing.pack_pieces(packing.cut_pieces(docs(texts, clash=True), BYTE)).collect()
    fill, n = check_packing(rows, texts, lambda t: library_ids(BYTE, t))
    assert n == -(-fill // 1024) or n * 1024 < 1.1 * fill
    assert packing.pack_pieces(packing.cut_pieces(empty_docs, BYTE)).count() == 0


def test_shortest_pack_first_places_each_rank_once():
    import random
    r = random.Random(7)
    for _ in range(50):
        size = r.choice([8, 64])
        hist = {k: r.randrange(1, 40) for k in r.sample(range(1, size + 1), r.randrange(1, 8))}
        slots = packing.shortest_pack_first(hist, size)
        seen, fill = {}, {}
        for length, lo, hi, first, offset in slots:
            for rank in range(lo, hi):
                assert (length, rank) not in seen
                seen[length, rank] = 1
                fill.setdefault(first + rank - lo, []).append((offset, length))
        assert len(seen) == sum(hist.values())
        for s in fill.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= size


def thue_morse(n):
    """Two different texts whose polynomial hashes modulo 2**64 agree for every odd base."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("path,spaces", [(BYTE, "leading"), (WORD, "dropped")])
def test_pieces_with_one_polynomial_hash_keep_their_own_ids(path, spaces):
    from odspark.llm.bpe import MemoEncoder
    enc = MemoEncoder(path, spaces)
    for n in (1024, 2048):
        a, b = thue_morse(n)
        for text in (f"{a} {b}", f"x {b} {a} {b} y", f"{b}\n{a}", f"{a} {a}b {b}"):
            assert list(array_of(enc.encode(text))) == library_ids(path, text)


def array_of(raw):
    return struct.unpack(f"<{len(raw) // 4}I", raw)


def test_distinct_spans():
    import random

    import numpy as np

    from odspark.llm.bpe import distinct_spans
    r = random.Random(6)
    spans = ["".join(r.choice("ab\x00\x01\x08é") for _ in range(r.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 40])))[:r.randrange(1, 41)]
             for _ in range(3000)]
    raw = [s.encode() for s in spans]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(x) for x in raw])
    pieces, which = distinct_spans(data, end - [len(x) for x in raw], end)
    assert len(set(pieces)) == len(pieces) == len(set(raw))
    assert [pieces[k] for k in which] == raw
