"""Token ids, packing and token files."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from fixtures import docs, empty, words
from tokenizers import Tokenizer

from plumbline.llm import packing, simple8b, tokens
from plumbline.runtime import scratch_path

BYTES, LOWER = (packing.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["a  b", "a b ", "\n a", "x\n\nb", "it's. foo's, don't 'tis", "<|endoftext|> foo <|endoftext|>.", "foo<|endoftext|>.", " é è", "A B\tC", "İstanbul ΑΣ Σ. foo", "1234, 5.", "... ,",
       ", x", "", None, "a\nb.\nc", "!!! x. y", "a\0b c", "x y z", "é ́a", "日本 語。 a", "a.b.c. d", "²½ x²,", " a b", "foo_bar_ x__", "a." * 2000]


def ids_of(file, text, end):
    return np.array(Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids + end, "<u4")


@pytest.mark.parametrize("file", [BYTES, LOWER])
@pytest.mark.parametrize("cached", [3, 700_000])
def test_ids_are_the_tokenizers(monkeypatch, file, cached):
    monkeypatch.setattr(tokens, "CACHED_WORDS", cached)
    rng = random.Random(0)
    marks = ["", "", ",", ".", "!!", "'s", "\n", "_", "-x", "%%%"]
    texts = ODD + [" ".join(w + rng.choice(marks) for w in words(rng, 40, rng.choice(["en", "de", "fr"])).split()) for _ in range(60)]
    enc = tokens.Encoder(file)
    for _ in range(2):
        flat, at = enc.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(file, t, []).tolist() for t in texts]
    flat, at = enc.encode(pa.array(texts).slice(5, 7))
    assert flat.tolist() == [i for t in texts[5:12] for i in ids_of(file, t, []).tolist()]
    assert enc.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_tournament_is_first_fit():
    rng = random.Random(1)
    tree, rooms = packing.Tournament(100), []
    for _ in range(3000):
        need = rng.randint(1, 100)
        place = next((i for i, r in enumerate(rooms) if r >= need), len(rooms))
        if place == len(rooms):
            rooms.append(100)
        assert tree.place(need) == (place, 100 - rooms[place])
        rooms[place] -= need


def test_packing(spark):
    table = docs(spark, 300)
    given = table.select("doc_id", "text").collect()
    out = packing.pack(table, BYTES, group=40).collect()
    want = sorted(repr(r["doc_id"]) + str(crc32(ids_of(BYTES, r["text"], [0]).tobytes())) for r in given)
    pieces, filled = {}, {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 1024 and crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault((repr(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], r["ids"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    got = []
    for (doc, n), mine in pieces.items():
        starts = sorted(mine, key=lambda x: x[0])
        times = sum(s == 0 for s, _ in starts)  # repeated rows
        joined = b"".join(i for s, i in starts[::times])
        assert len(joined) == 4 * n
        got += [doc + str(crc32(joined))] * times
    assert sorted(got) == want
    for mine in filled.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(filled) * 1024 < 1.08 * total + 1024 * 10
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << int(b), 150, dtype=np.uint64) for b in rng.integers(1, 64, 80)]
    values = np.concatenate([*parts, np.zeros(500, np.uint64), np.full(7, 2**64 - 1, np.uint64), np.full(3, 1 << 60, np.uint64), np.full(3, (1 << 60) - 1, np.uint64)])
    for few in (0, 24, 10_000):
        simple8b._FEW = few
        at = np.sort(np.concatenate([[0, 0, len(values), len(values)], rng.integers(0, len(values), 60)]))
        coded = simple8b.encode(values, at)
        assert (simple8b.decode(coded[0], coded[1], np.diff(at), coded[2]) == values).all()
        assert coded[3].sum() == len(coded[2]) == (values >= 1 << 60).sum()
    simple8b._FEW = 24
    words_, n, *_ = simple8b.encode(np.arange(60, dtype=np.uint64) % 2, np.array([0, 60]))
    assert len(words_) == 1 and n.tolist() == [1]


@pytest.mark.parametrize("block", [1, 500, 1 << 16])
def test_token_files(spark, monkeypatch, block):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", block)
    table = docs(spark)
    given = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()), r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    path = scratch_path(spark, "tokens")
    simple8b.write_tokens(table, path, LOWER)
    want, start = [], 0
    for _, doc, text in given:
        ids = ids_of(LOWER, text, [1])
        want.append((doc, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    found = [tuple(r) for r in simple8b.read_checksums(spark, path).collect()]
    assert sorted(found, key=lambda r: r[1]) == want
    assert sorted((r["start"], crc32(r["ids"])) for r in simple8b.read_tokens(spark, path).collect()) == [(w[1], w[3]) for w in want]


def test_empty_token_files(spark):
    path = scratch_path(spark, "tokens")
    simple8b.write_tokens(empty(spark), path, LOWER)
    assert simple8b.read_checksums(spark, path).count() == 0


@pytest.mark.parametrize("file", [LOWER, BYTES])
def test_signs_after_every_letter(file):
    """Letters whose normal form ends in a mark, and letters that are none to the tokenizer, keep the signs after them."""
    from plumbline.llm.tokens import Encoder

    enc = Encoder(file)
    texts = [f"a {chr(c)}-- b" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    flat, at = enc.encode(pa.array(texts))
    want = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, a, b, e in zip(texts, at, at[1:], want) if flat[a:b].tolist() != e.ids] == []
