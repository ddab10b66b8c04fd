import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from helpers import HARD, as_dicts, documents, empty, prose, rows, with_odd_columns
from timeline_lake.llm import packing, token_files
from timeline_lake.llm.bpe import PrefixTokens, TextEncoder, decode, digests, encode, read_ranks
from timeline_lake.llm.tokens import BatchEncoder, segments, tokenizer_cache

JSON, RANKS = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "a  b", "x  y", "a \n b\n\n c", "it's don't  \t x", "\x1c \x1c a", "日本語 テキスト 🙂🙂", "<|endoftext|> a", "é" * 100,
    "a" * 300 + " " * 200 + "b", "abc.\nDef, x\ny z.\n w\n\nq a\n.b ab,,c é,é\nÉ. ", "² x² 1ab ab1 ⅷ", "a|b | c| |", "ж\nж ԱԲ ώ.", prose(3, 500) + ".\n" + prose(4),
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_both_encoders_give_the_library_ids(reference, text):
    want = reference.encode_ordinary(text)
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    assert np.frombuffer(tokenizer_cache(JSON).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids == want
    encoder = TextEncoder(RANKS, PATTERN)
    ids = encoder.encode(text)
    assert ids.tolist() == want and encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("limit, chunk_bytes", [(5, 40), (10**6, 10**6)])
def test_texts_encoded_together_give_the_library_ids(limit, chunk_bytes):
    draw = random.Random(9)
    bits = ["the", "wörd", "Жук", "日本", "x1", "12", "'s", "it's", "a.b", "##", "...", ",", "|", "\n", "\n\n", "\t", "\x01", "\xa0", "\x1c", "²", "µ", "ǆ", "🙂", "<|endoftext|>"]
    texts = [None, *TEXTS, *["".join(draw.choice(bits) + draw.choice(["", " ", " ", " ", "\n", ".\n", ", ", "  "]) for _ in range(draw.randint(1, 30))) for _ in range(3000)]]
    encoder = BatchEncoder(JSON, limit, chunk_bytes)
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    got = []
    # A slice, as of a larger batch.
    for ids, sizes in encoder.chunks(pa.array(["left out", *texts]).slice(1), 7):
        got += [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_the_memory_of_pieces_is_bounded():
    encoder = BatchEncoder(JSON, 100, 1000)
    for seed in range(40):
        list(encoder.chunks(pa.array([prose(seed, 300), "日本" * 5000 + str(seed), None]), 0))
    assert max(map(len, encoder.new)) <= 64 and len(encoder.new) + len(encoder.old) < 1200


def test_long_texts_are_cut_at_safe_places(reference):
    text = prose(5, 3000) + ".\n" + prose(6, 3000)
    parts = list(segments(text, 1000))
    assert len(parts) > 10 and "".join(parts) == text
    assert [i for p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_a_full_cache_changes_nothing(reference):
    encoder = TextEncoder(RANKS, PATTERN)
    encoder.cache.limit = 7
    for seed in range(20):
        assert encoder.encode(prose(seed)).tolist() == reference.encode_ordinary(prose(seed))


def test_appends_and_edits_are_exact(reference):
    model = TextEncoder(RANKS, PATTERN).model
    draw = random.Random(3)
    for _ in range(120):
        state = PrefixTokens(model, bytes(draw.choice(b"abcde the in ing er") for _ in range(draw.choice([0, 5, 40, 900]))))
        for _ in range(3):
            i = draw.randint(0, len(state.data))
            state.replace(i, min(len(state.data), i + draw.randint(0, 5)), bytes(draw.choice(b"the in") for _ in range(draw.randint(0, 6))))
            state.append(b"ing")
        assert state.tokens() == reference._encode_single_piece(state.data)
    state = PrefixTokens(model, b"the thing in the end" * 1000)
    assert state.replace(5000, 5002, b"xyz") < 600
    assert state.tokens() == reference._encode_single_piece(state.data)


def test_encode_and_decode_columns(spark, reference):
    docs = with_odd_columns(documents(spark))
    encoded = encode(docs, RANKS, PATTERN)
    texts = {r[0]: r[1] or "" for r in HARD}
    assert {r["doc_id"]: r["ids"] for r in as_dicts(encoded)} == {i: reference.encode_ordinary(t) for i, t in texts.items()}
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in as_dicts(decode(encoded, RANKS, PATTERN))} == texts
    assert digests(empty(spark), RANKS, PATTERN).count() == 0


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Document by document, without counts."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        box, gap = [], capacity
        while fit := next((n for n in left if n <= gap), None):
            box.append(fit)
            left.remove(fit)
            gap -= fit
        if gap and len(box) > 1:
            room, best = gap + box[-1], (box[-1], None)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best[0] < a + b <= room:
                        best = (a + b, (a, b))
            if best[1]:
                back = box.pop()
                for n in best[1]:
                    left.remove(n)
                    box.append(n)
                left.append(back)
                left.sort(reverse=True)
        out.append(box)
    return out


def test_plan_is_a_packing_as_good_as_the_plain_method():
    draw = random.Random(1)
    for trial in range(40):
        lengths = [draw.randint(1, 60) if trial % 2 else draw.choice([7, 19, 20, 31, 60]) for _ in range(draw.randint(0, 90))]
        steps = packing.plan(dict(Counter(lengths)), 60)
        assert Counter(n for times, box in steps for n in box for _ in range(times)) == Counter(lengths)
        assert all(sum(box) <= 60 for _, box in steps)
        assert sum(times for times, _ in steps) <= len(best_two_fit(lengths, 60)) + 1


def test_the_smallest_is_replaced_by_two_that_fit_better():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]


def test_pack_gives_gapless_sequences(spark):
    docs = with_odd_columns(documents(spark, HARD + rows(*[prose(i, 5 + i % 40) for i in range(200)], first=100) + [(None, "no id", None, None, 1)] * 2, 4))
    found = packing.pieces(docs, JSON, capacity=64).cache()
    packed = as_dicts(packing.pack(found, 64, rows_per_block=8))
    assert len(packed) == found.count()
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in packed)
    assert len(by_sequence) <= -(-total // 64) * 1.05 + 1
    encoder = tokenizer_cache(JSON)
    for doc_id, text, *_ in HARD:
        ids = encoder.encode(text or "") + (2).to_bytes(4, "little")
        mine = sorted((r for r in packed if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]]
        assert all(r["length"] == 64 for r in mine[1:]) and sum(r["length"] for r in mine) == len(ids) // 4
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in mine)


def test_pack_of_nothing(spark):
    assert packing.pack(packing.pieces(empty(spark), JSON)).count() == 0


@pytest.mark.parametrize(
    "ids", [[], [0], [2**64 - 1, 5, 2**60, 2**60 - 1, 2**53 + 1] * 3, list(range(1000)), [1] * 61 + [70000] * 7, [0] * 200, [2**32 - 1] * 5], ids=range(7)
)
def test_words_round_trip(ids):
    words, escapes = token_files.pack_words(np.array(ids, np.uint64))
    assert token_files.unpack_words(words, escapes, len(ids)).tolist() == ids


def test_words_are_dense():
    words, _ = token_files.pack_words(np.ones(600, np.uint64))
    assert len(words) == 10


def test_damage_is_noticed():
    block = bytearray(token_files.write_block([1, 2], [3, 2], np.arange(5)))
    assert [(d, s.tolist(), i.tolist()) for d, s, i in token_files.read_blocks(bytes(block))] == [([1, 2], [0, 3, 5], [0, 1, 2, 3, 4])]
    block[70] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_blocks(bytes(block)))


def test_token_files_round_trip(spark, tmp_path):
    data = HARD + rows(*[prose(i) for i in range(40)], first=1000) + [(None, "no id", None, None, 1), (8, prose(1), "en", "src", 1)]
    token_files.write_token_files(with_odd_columns(documents(spark, data, 5)), JSON, str(tmp_path / "ids"), block_ids=500)
    found = sorted(as_dicts(token_files.with_global_starts(token_files.read_token_files(spark, str(tmp_path / "ids")))), key=lambda r: r["start"])
    encoder, start = tokenizer_cache(JSON), 0
    assert len(found) == len(data)
    texts = defaultdict(list)
    for doc_id, text, *_ in data:
        texts[doc_id].append(text or "")
    ids_in_order = [r["doc_id"] for r in found]
    assert ids_in_order == sorted(ids_in_order, key=lambda i: -1 if i is None else i)
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
        assert r["ids_crc32"] in {zlib.crc32(encoder.encode(t) + bytes(4)) for t in texts[r["doc_id"]]}


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(empty(spark), JSON, str(tmp_path / "ids"))
    assert token_files.with_global_starts(token_files.read_token_files(spark, str(tmp_path / "ids"))).count() == 0
