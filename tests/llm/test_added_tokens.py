"""Odd texts, and those that hold an added token's content, get the ids of the tokenizers library at its defaults."""

import zlib

import numpy as np


def test_added_tokens_in_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from plateaux.llm.packing import pack
    from plateaux.llm.token_files import token_output
    from plateaux.llm.tokens import encoder, vocabulary_path

    texts = [" " * 1_000_000, "\t" * 300_000, "x" * 200_000, "a  b\n c \x85 d\xa0 e  ", " lead", "日本 語 のテキスト", "a <|endoftext|> b", "plain words", "<|endoftext|><|endoftext|>", "日本 <|endoftext|> é", "<|endoftext", "", "isn't it, l'été?  x"]
    untouched = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*untouched.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert 50256 in ids[6] and encoder(vocabulary_path()).in_pieces
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    pieces = {}
    for x in pack(docs).collect():
        pieces.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["ids_crc32"]))
    for i, x in enumerate(ids):
        assert [(s, n, zlib.crc32(x[s:s + n].tobytes())) for s, n, _ in sorted(pieces[i])] == sorted(pieces[i]) and sum(n for _, n, _ in pieces[i]) == len(x)
    files = {x["doc_id"]: x for x in token_output(spark, docs).collect()}
    assert {d: (x["n_tokens"], x["ids_crc32"]) for d, x in files.items()} == want
    assert [files[i]["start"] for i in range(len(ids))] == np.cumsum([0, *map(len, ids[:-1])]).tolist()


def test_random_odd_texts_have_the_library_s_ids():
    """Words learned together or one by one, forgotten and learned again, beside an untouched tokenizer."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from plateaux.llm.tokens import Encoder, vocabulary_path

    untouched = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc, rng = Encoder(vocabulary_path()), random.Random(5)
    letters = "ab  \n\t.,'sSt19éß日\x85\xa0　\x1c\x1dĠÄ-_/🙂"
    for k in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        if k % 10 == 0:
            text += " " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(600))
        want = untouched.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == np.array(want, enc.dtype).tobytes(), text
        if k % 200 == 0:
            enc.known.clear()
            enc.known_before.clear()
