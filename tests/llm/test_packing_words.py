"""Finding of round 3 on op4: words are known by hash and bytes in arrays, and Latin letters go straight to the model."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locuskey.llm import textkernel
from locuskey.llm.packing import WordIds
from locuskey.llm.textkernel import Words

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(encoder: WordIds, texts: list[bytes]) -> list[list[int]]:
    data = b"".join(texts)
    words = Words(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), marks=encoder.marks)
    ids, begins = encoder.ids(words)
    edges = begins[words.first]
    return [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _texts(n: int) -> list[str]:
    r = random.Random(11)
    letters = [chr(c) for c in range(0xC0, 0x100)]
    pieces = ["the", "Tion", "ING", *letters, *"aeiouXYZ", "é", "İ", "ß", "ǰ", "J̌", "ﬁ", "Σ", "1", "'s", ",", "...", "!?", "<|", "<|endoftext|>", "|>", "ª", "µ", "東", "\U0001f600", "≠", "̸"]
    return ["".join(r.choice(pieces) if r.random() < 0.8 else " " for _ in range(r.randint(1, 12))) for _ in range(n)] + [x + y for x in letters for y in (",", "'s", "́", "a.", "")]


def test_ids_are_the_tokenizers_own():
    tokenizer, texts = Tokenizer.from_file(PATH), _texts(6000)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = WordIds(PATH, 2000)
    assert encoder.short
    for a in range(0, len(texts), 500):
        assert _ids(encoder, [t.encode() for t in texts[a : a + 500]]) == want[a : a + 500]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = _texts(300)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(textkernel, "hash_runs", lambda data, starts, ends, lower=False: ((ends - starts) % 3).astype(np.uint64))
    encoder = WordIds(PATH)
    for a in range(0, len(texts), 50):
        assert _ids(encoder, [t.encode() for t in texts[a : a + 50]]) == want[a : a + 50]


@pytest.mark.parametrize("word", [b"caf\xc3\xa9", b"\xc3\x80\xc3\x89", b"stra\xc3\x9fe,", b"n\xc3\xado!!"])
def test_latin_letters_do_not_need_the_whole_tokenizer(word):
    encoder = WordIds(PATH)
    whole = encoder._encode([word.decode()])[0]
    sent: list[str] = []
    encoder._encode = lambda texts, f=encoder._encode: sent.extend(texts) or f(texts)
    assert _ids(encoder, [word]) == [whole] and not any(any(c.isalpha() for c in t) for t in sent)
