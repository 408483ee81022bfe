"""Token counts, byte-level BPE and packing against the libraries."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import byte_bpe, packing, queries, token_counts, words

WORDS, RANKS = queries.WORD_TOKENIZER, queries.BYTE_RANKS
ODD = ["é", "é", "́", "ß", "Σ", "ας", "中", "٣", " ", "　", "😀", "<|endoftext|>", "<|ENDOFTEXT|>",
       "<|", "'s", "'re", "'ll", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", ".", ",", "!?", "a.b", "A", "Zz", "12", " ", "x"]
DOCS = "doc_id long, text string, n_bytes string, ids int, sequence_id string, lang string"


def fuzz(n: int, seed: int) -> list:
    rng = random.Random(seed)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [None, "", " ", "a" * 50_000, "ab " * 20_000, *made]


def docs(spark, texts):
    rows = [(i, t, "x", 1, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[1], (None, "no id", None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_slices_give_the_library_ids(library):
    texts = fuzz(3000, 1)
    n, ids = words.encoded(pa.array(texts), WORDS, keep_ids=True)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_byte_batches_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d"] * 9)], ["t"])
    parts = list(words.byte_batches([batch], 0, 20))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert len(parts) > 5


def test_token_counts(spark, library):
    texts = fuzz(200, 2)
    found = token_counts.token_counts(docs(spark, texts), WORDS).collect()
    assert len(found) == len(texts) + 2
    for row in found:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(docs(spark, texts).limit(0), WORDS).count() == 0


def test_bpe_like_the_library():
    ranks = byte_bpe.ranks(RANKS)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={}
    )
    texts = fuzz(5000, 3) + ["\n" * 3000, "'s" * 2000, "a b" * 900_000]
    ids, n = ranks.texts(pa.array(texts))
    want = [library.encode_ordinary(t or "") for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert ranks.placed(ids, None).tobytes() == "".join(t or "" for t in texts).encode()


def test_scan_composes_like_a_loop():
    symbols = np.random.default_rng(5).integers(0, 14, 3000).astype(np.uint8)
    symbols[0] |= 0
    state, want = byte_bpe.BEGIN, []
    for s in symbols:
        want.append(state)
        state = byte_bpe.STEP[s, state]
    assert byte_bpe.scan(symbols).tolist() == want


def test_bpe_round_trip_and_offsets(spark):
    texts = fuzz(100, 4)
    df = docs(spark, texts)
    encoded = byte_bpe.encode(df, RANKS)
    for row in byte_bpe.decode(encoded.select("doc_id", "ids"), RANKS).collect():
        assert bytes(row.decoded).decode() == ("no id" if row.doc_id is None else texts[row.doc_id] or "")
    # The same by offsets, in a pass of its own and in that of the encoder.
    plain = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect()}
    placed = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS, offsets_col="offsets").collect()}
    whole = {r.doc_id: bytes(r.decoded) for r in byte_bpe.encode(df, RANKS, offsets=False, decoded=True).collect()}
    assert plain == placed == whole
    table = byte_bpe.ranks(RANKS)
    for row in encoded.collect():
        lengths = table.lengths[np.frombuffer(row.ids, "<u4")]
        assert row.offsets == (np.cumsum(lengths) - lengths).tolist()
    assert byte_bpe.encode(df.limit(0), RANKS).count() == 0


def check_packed(rows, capacity):
    places = defaultdict(list)
    for row in rows:
        places[row.sequence_id].append((row.offset, row.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(spark, library):
    texts = fuzz(150, 6)
    df = docs(spark, texts)
    rows = packing.best_fit(packing.token_pieces(df, WORDS, keep_ids=True)).collect()
    used = check_packed(rows, 2048)
    got = defaultdict(int)
    for row in rows:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = ids[row.start : row.start + row.length]
        assert row.start == 2048 * row.piece and row.length == min(2048, len(ids) - row.start)
        assert row.ids == own and row.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        got[row.doc_id] += row.length
    total = sum(r.length for r in rows)
    assert got[1] == 2  # "" twice
    assert used <= 1.02 * total / 2048 + 2
    assert packing.best_fit(packing.token_pieces(df.limit(0), WORDS)).count() == 0


def test_pieces_of_a_large_batch_take_little_memory(spark, monkeypatch):
    """What a worker holds does not grow with Spark's batches (24 MB of text here)."""
    df = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, function, schema: function)
    cut = packing.token_pieces(df, WORDS)
    texts = pa.array(["a bc, " * 1000] * 4000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), texts], ["doc_id", "text"])
    list(cut(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        lengths = [sum(out.column(3).to_pylist()) for out in cut(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(lengths) == 4000 * (len(words.encoded(texts[:1], WORDS, keep_ids=True)[1]) + 1)
    assert peak < 200 << 20


def test_gathered_is_ragged_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(words, "GATHERED", 7)
    ids = rng.integers(0, 99, 500).astype(np.uint32)
    for n in (0, 1, 7, 60):
        starts, lengths = rng.integers(0, 490, n), rng.integers(0, 9, n)
        found = words.gathered(ids, starts, lengths)
        assert found.dtype == np.uint32 and found.tolist() == ids[words.ragged(starts, lengths)].tolist()


def test_packing_ties_and_hot_lengths(spark):
    lengths = [7] * 4000 + [10] * 50 + list(range(1, 11)) * 20
    df = spark.createDataFrame([(i % 999, n, "x") for i, n in enumerate(lengths)], "id long, length long, offset string")
    rows = packing.best_fit(df, capacity=10).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert check_packed(rows, 10) <= 4000 + 50 + 160


def test_sweep_is_best_fit():
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 200))]
        counts = {s: sizes.count(s) for s in sizes}
        gaps, fill = [], 0
        for s in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                fill += 1
                gaps.append(40 - s)
        runs = packing.sweep(counts, 40)
        used = {first + i for _, a, b, first, _ in runs for i in range(b - a + 1)}
        assert len(used) <= fill


def test_slices_that_come_again_are_encoded_once():
    """A full cache keeps what was asked for more than once."""
    from quarry.llm.words import SliceCache

    calls = []

    def encode(slices):
        calls.extend(slices)
        counts = np.array([len(s) for s in slices])
        return np.frombuffer(b"".join(slices), np.uint8).astype(np.uint32), counts

    cache = SliceCache(encode, most=10)
    common = [b"the", b" of", b""]
    for i in range(20):
        asked = [*common, *(b"w%d-%d" % (i, j) for j in range(5))]
        starts, counts = cache.look_up(asked)
        found = [bytes(cache.ids[a : a + n].astype(np.uint8)) for a, n in zip(starts, counts)]
        assert found == asked and len(cache.place) <= 10
    assert [calls.count(s) for s in common] == [1, 1, 1] and len(calls) == 103
