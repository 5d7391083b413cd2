import random

import numpy as np
import public_tokenizers
from dockflow.llm import bpe
from tokenizers import Tokenizer

import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def theirs(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    return ids


def test_encoder_equals_the_library():
    reader, coder, r = Tokenizer.from_file(PATH), bpe.codec(PATH), random.Random(5)
    signs = "aabcdehinorst'!*1  \n\tÉéΣßİñ中😀\u0301\x1c\x85 <|endoftext|>\u1c89"
    texts = ["", "a" * 999, "ab" * 500, "<|startoftext|>x<|endoftext|>", "don't WE'LL 's", "ΑΣ ΣΑΣ"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        ids = reader.encode(text, add_special_tokens=False).ids
        packed = coder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert coder.decode(packed).decode() == reader.decode(ids, skip_special_tokens=False)


def test_every_token_is_cut_as_the_merges_do():
    coder = bpe.codec(PATH)
    reader = Tokenizer.from_file(PATH)
    names = [t for t in reader.get_vocab() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()][::50]
    for name in names:
        ids = np.frombuffer(coder.encode(name[:-4]), "<u4").tolist()
        assert ids == reader.encode(name[:-4], add_special_tokens=False).ids


def test_rows(spark):
    got = bpe.encode_decode(cases.frame(spark), PATH).collect()
    reader = Tokenizer.from_file(PATH)
    want = []
    for row in cases.sample():
        ids = reader.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], len(ids), np.array(ids, "<u4").tobytes(), reader.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, bytes(x[2]))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got), key=key) == sorted(want, key=key)
    assert bpe.encode_decode(cases.nothing(spark), PATH).count() == 0
