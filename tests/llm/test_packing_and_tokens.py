import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe, packing, tokencounts
from docloom.llm.tokenizers import encode, public, public_pattern, rank_encoder
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public("byte_bpe_50k.json"))


def reference_ids(text):
    """The ids of the library's tokenizer as its file has it."""
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts):
    """Every id lies in one piece, pieces fill sequences without gaps, none is over the limit."""
    ids = {i: np.array([*reference_ids(t or ""), 0], "<u4") for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_pack_documents(table):
    docs = table("documents")
    rows = packing.pack_documents(docs).collect()
    assert check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}) == 0


def test_odd_texts_pack(spark, odd, empty):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 1, 2)}
    df = odd.where("doc_id NOT IN (1, 2)")
    check_pieces(packing.pack_documents(df).collect(), texts)
    assert packing.pack_documents(empty).collect() == []
    repeated = [r for r in packing.pack_documents(odd.where("doc_id = 1")).collect()]
    assert sum(r.length for r in repeated) == 2 * repeated[0].doc_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=80))
def test_pack_fills_sequences(lengths):
    used, seen = defaultdict(int), defaultdict(int)
    for doc, _, n, seq, offset in sorted(packing.pack(lengths, 1024), key=lambda p: (p[3], p[4])):
        assert offset == used[seq] and n > 0
        used[seq] += n
        seen[doc] += n
    assert [seen[d] for d in range(len(lengths))] == lengths
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())
    assert sorted(used) == list(range(len(used)))


def slow_pack(lengths, size):
    """The same rule by trying every sequence: full pieces, then each tail to the cheapest sequence with room, then cuts."""
    pieces, tails, n = [], [], 0
    for doc, length in enumerate(lengths):
        for k in range(length // size):
            pieces.append((doc, k * size, size, n, 0))
            n += 1
        if length % size:
            tails.append((length % size, doc, length - length % size))
    total = sum(t[0] for t in tails)
    rooms = [size] * (total // size) + [int(b) for b in (1 << k for k in reversed(range(20))) if (total % size) & b]
    used, costs, left = [0] * len(rooms), [0.0] * len(rooms), []
    for length, doc, start in sorted(tails, key=lambda t: (-t[0], t[1])):
        fits = [(costs[s], s) for s in range(len(rooms)) if rooms[s] - used[s] >= length]
        if not fits:
            left.append((length, doc, start))
            continue
        _, s = min(fits)
        pieces.append((doc, start, length, n + s, used[s]))
        used[s] += length
        costs[s] += packing.cost(length, 1.0, 1 / 512)
    for length, doc, start in left:
        while length:
            _, s = min((costs[s], s) for s in range(len(rooms)) if used[s] < rooms[s])
            m = min(length, rooms[s] - used[s])
            pieces.append((doc, start, m, n + s, used[s]))
            used[s], start, length = used[s] + m, start + m, length - m
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=120), st.sampled_from([64, 1000, 1024]))
def test_every_tail_goes_to_the_cheapest_sequence_with_room(lengths, size):
    assert sorted(packing.pack(lengths, size)) == sorted(slow_pack(lengths, size))


def test_many_tails_go_to_the_cheapest_sequence_with_room():
    rng = random.Random(3)
    lengths = [rng.randrange(20, 1000) for _ in range(1500)]
    assert sorted(packing.pack(lengths, 1024)) == sorted(slow_pack(lengths, 1024))


def test_strings_of_special_tokens(spark):
    """An added token's string is one id, as the library reads the file; null doc_ids and repeated rows are packed too."""
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>x"), (None, "a <|endoftext|> b"), (None, None), (3, "a < |endoftext|>")]
    assert reference_ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces([r for r in packing.pack_documents(df.where("doc_id IS NOT NULL")).collect()], {i: t for i, t in rows if i})
    got = packing.pack_documents(df).collect()
    assert sum(r.length for r in got) == sum(len(reference_ids(t or "")) + 1 for _, t in rows)
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(i, len(reference_ids(t or "")) + 1) for i, t in rows}
    lengths = sorted((r.doc_id or 0, r.n_tokens) for r in tokencounts.token_lengths(df).collect())
    assert lengths == sorted((i or 0, len(reference_ids(t or ""))) for i, t in rows)


def test_costs_are_balanced():
    rng = random.Random(0)
    lengths = [rng.randrange(20, 600) for _ in range(3000)]
    costs = defaultdict(float)
    for _, _, n, seq, _ in packing.pack(lengths, 1024):
        costs[seq] += packing.cost(n, 1.0, 1 / 512)
    values = sorted(costs.values())[50:-50]
    assert values[-1] < 1.6 * values[0]


def tiktoken_ids(text):
    return rank_encoder(public("byte_bpe_multi_50k.tiktoken"), public_pattern()).encode_ordinary(text)


def check_coded(rows):
    for text, r in rows:
        raw = np.array(tiktoken_ids(text), "<u4").tobytes()
        assert r.n_tokens == len(raw) // 4
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_is_that_of_the_library(table, odd, empty):
    docs = table("documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    check_coded([(texts[r.doc_id], r) for r in bpe.encode_documents(docs).collect()])
    source = [r.text or "" for r in odd.orderBy("rank").collect()]
    got = bpe.encode_documents(odd.orderBy("rank").coalesce(1)).collect()
    check_coded(list(zip(source, got, strict=True)))
    assert bpe.encode_documents(empty).collect() == []


def test_ids_and_bytes_come_back(odd):
    for r in bpe.encode_documents(odd.where("doc_id = 10"), keep=True).collect():
        assert r.ids == tiktoken_ids("Ünïcödé 漢字 😀  \x1c\x85 end")
        assert bytes(r.decoded).decode() == "Ünïcödé 漢字 😀  \x1c\x85 end"


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80), st.text(alphabet="abé ", max_size=40), st.sampled_from("aé1!. \n"), st.integers(1, 900))
def test_codec_round_trip(a, b, c, n):
    codec = bpe.codec(public("byte_bpe_multi_50k.tiktoken"), public_pattern())
    texts = [x for x in (a, b, c * n, a + c * n + b)]
    for text, (ids, raw) in zip(texts, codec.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_ids(text)
        assert raw == text.encode()


def test_long_words_contract_as_the_library_does():
    rng = random.Random(4)
    codec = bpe.codec(public("byte_bpe_multi_50k.tiktoken"), public_pattern())
    words = ["".join(rng.choices("abcdeinorstlé", k=rng.randrange(300, 1500))) for _ in range(6)] + ["ab" * 400, "a" * 2001]
    for w, (ids, _) in zip(words, codec.encode_batch(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_ids(w)


@pytest.fixture(scope="module")
def counted(table):
    docs = table("documents")
    lengths = sorted(len(reference_ids(r.text or "")) for r in docs.collect())
    limits = tokencounts.limit_table(tokencounts.length_histogram(tokencounts.token_lengths(docs))).cache()
    return lengths, limits


def test_limits_against_brute_force(counted):
    lengths, limits = counted
    rows = limits.collect()
    assert sorted(r.max_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        kept = sum(min(n, r.max_tokens) for n in lengths)
        over = sum(n > r.max_tokens for n in lengths)
        assert (r.kept_tokens, r.docs_over, r.docs_within) == (kept, over, len(lengths) - over)
        assert r.n_docs == lengths.count(r.max_tokens) and r.total_tokens == sum(lengths) and r.lost_tokens == sum(lengths) - kept


def test_any_limit_and_quantile(spark, counted):
    lengths, limits = counted
    asked = spark.createDataFrame([(n,) for n in (0, 1, 100, 1000, 10**7)], "max_tokens long")
    got = {r.max_tokens: (r.kept_tokens, r.docs_over) for r in tokencounts.answer(limits, asked).collect()}
    assert got == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in (0, 1, 100, 1000, 10**7)}
    assert tokencounts.quantile(limits, 0.5).first()[0] == lengths[-(-len(lengths) // 2) - 1]


def test_odd_lengths(odd, empty):
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_lengths(odd).collect()}
    assert got[3] == 0 and got[4] == 0 and got[8] == len(reference_ids("long " * 30000))
    assert tokencounts.limit_table(tokencounts.length_histogram(tokencounts.token_lengths(empty))).collect() == []


def test_texts_beyond_the_rank_encoders_reach():
    """A million blanks overflow its regex engine; the tokenizer itself takes them."""
    text = " " * 1_000_000 + "x"
    json_path, rank_path = public("byte_bpe_50k.json"), public("byte_bpe_50k.tiktoken")
    assert encode(text, json_path, rank_path, public_pattern()) == reference_ids(text)
    codec = bpe.codec(public("byte_bpe_multi_50k.tiktoken"), public_pattern())
    ids, raw = codec.encode_batch([" " * 20_000 + "x"])[0]
    assert raw == b" " * 20_000 + b"x" and np.frombuffer(ids, "<u4").tolist() == tiktoken_ids(" " * 20_000 + "x")
