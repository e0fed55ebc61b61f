import random

import pytest

from arbordelta.llm.tokenise import BYTE_BPE_50K, Part, encoder, join_parts, join_tree, token_ids

MIX = ["a", "b", "l", "e", "s", "'", "'l", "'r", "e", " ", "  ", "\n", "\t", "\r\n", "1", "23", "!", "ab", "é", "漢", "\x1c", "​", " ", "😀", "<|endoftext|>", "the", "ing", "﻿"]


@pytest.fixture(scope="module")
def enc():
    return encoder(BYTE_BPE_50K)


def test_parts_join_to_the_whole(enc):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(MIX) for _ in range(rng.randint(1, 60)))
        whole = Part.encoded(enc, text)
        k = rng.randint(1, 9)
        joined = join_tree(enc, [Part.encoded(enc, text[i:i + k]) for i in range(0, len(text), k)])
        assert joined.ids.tolist() == whole.ids.tolist(), (text, k)
        at = rng.randint(0, len(text))
        two = join_parts(enc, Part.encoded(enc, text[:at]), Part.encoded(enc, text[at:]), window=rng.choice([1, 2, 256]))
        assert two.ids.tolist() == whole.ids.tolist(), (text, at)


def test_unsplit_pieces(enc):
    rng = random.Random(2)
    for _ in range(1500):
        piece = "".join(rng.choice("abestinghl") for _ in range(rng.randint(1, 300)))
        assert enc.piece(piece, leaf=rng.choice([4, 8, 12, 40, 256])) == enc.unsplit.encode(piece)
    for _ in range(300):
        piece = "".join(rng.choice("漢字かé😀a") for _ in range(rng.randint(1, 300)))
        assert enc.piece(piece, leaf=rng.choice([4, 8, 12, 40, 256])) == enc.unsplit.encode(piece)
    for text in ("a" * 5000, " " * 5000, "ab" * 2500, "=" * 5000):
        assert join_tree(enc, [Part.encoded(enc, text[i:i + 700]) for i in range(0, 5000, 700)]).ids.tolist() == enc.bpe.encode_ordinary(text)


def test_rows(spark, enc):
    rng = random.Random(3)
    texts = [None, "", " ", "﻿x", "<|endoftext|>", "it's", *("".join(rng.choice(MIX) for _ in range(n)) for n in (10, 900, 5000)), "a" * 20_000, " \n" * 9000, "x" * 3000 + " y" * 3000]
    rows = [(i, t, 1, [1]) for i, t in enumerate(texts)] + [(None, "null id", 1, None), (11, texts[11], 1, None), (11, texts[11], 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq int, ids array<int>")
    want = sorted((-1 if r[0] is None else r[0], enc.bpe.encode_ordinary(r[1]) if r[1] else []) for r in rows)
    for spread_chars, part in ((8192, 1024), (2000, 701), (2, 7000), (1 << 20, 5)):
        got = token_ids(df, spread_chars=spread_chars, part_chars=part).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want, spread_chars
    assert token_ids(df.limit(0)).count() == 0


def test_decodes_to_the_text(spark, enc):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in token_ids(docs, spread_chars=500, part_chars=97).collect()}
    assert got.keys() == texts.keys()
    assert all(enc.bpe.decode(ids) == (texts[d] or "") for d, ids in got.items())
    assert all(enc.bpe.encode_ordinary(texts[d] or "") == ids for d, ids in got.items())


def test_long_pieces_are_joined_from_their_halves(enc, monkeypatch):
    from arbordelta.llm import tokenise

    monkeypatch.setattr(tokenise, "PIECE_BYTES", 64)
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["ab", "漢", "  ", "é", "x" * 40, "=" * 30, " " * 25, "'s", "''", "😀", "the", "漢字" * 20]) for _ in range(rng.randint(1, 30)))
        k = rng.randint(1, 40)
        assert join_tree(enc, [Part.encoded(enc, text[i:i + k]) for i in range(0, len(text), k)]).ids.tolist() == enc.bpe.encode_ordinary(text), text


def test_anchors_split_whatever_is_around(enc):
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice([*MIX, "A", "Z", "[", "`", "{", "~", "@", "/", "9", "0", "''"]) for _ in range(rng.randint(2, 25)))
        starts = {m.start() for m in enc.split.finditer(text)}
        assert all(m.start() in starts for m in enc.anchor.finditer(text)), text
