"""Words that the encoder puts together, against the merges one by one."""

import json

import numpy as np
import pytest
import regex
from public_tokenizers import PATTERN

from seqpart.llm import bpe


def _spec() -> bytes:
    letters = {b: c for c, b in bpe.byte_letters().items()}
    merges = ["a b", "b c", "ab c", "c c", "bc c", "a a", "c a", "b b", "bb a", "abc ca"]
    vocab = {letters[b]: b for b in range(256)}
    for merge in merges:
        vocab.setdefault(merge.replace(" ", ""), len(vocab))
    return json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}).encode()


def _merged(own: bpe.Encoder, word: bytes) -> list[int]:
    ids = [own.id_of[bytes([b])] for b in word]
    while True:
        ranked = [(own.rank[pair], at) for at, pair in enumerate(zip(ids, ids[1:])) if pair in own.rank]
        if not ranked:
            return ids
        at = min(ranked)[1]
        ids[at:at + 2] = [own.id_of[own.token[ids[at]] + own.token[ids[at + 1]]]]


def test_words_are_those_of_the_merges():
    own, rng = bpe.Encoder(_spec()), np.random.default_rng(3)
    for _ in range(3000):
        word = bytes(rng.choice(list(b"abc"), rng.integers(1, 14)).astype(np.uint8))
        assert own.encode_word(word) == _merged(own, word), word


def test_edges_of_a_token_and_pairs_are_worked_out_once():
    own = bpe.Encoder(_spec())
    a, b = own.id_of[b"abc"], own.id_of[b"ca"]
    assert own._edge(a, 1) is own._edge(a, 1)
    told = own.compatible(a, b)
    own._edge = None  # a known pair asks for no edges
    assert own.compatible(a, b) == told


def _words(n: int) -> list[bytes]:
    rng = np.random.default_rng(5)
    return [b"", b"a", *(bytes(rng.choice(list(b"abc\x00\xff"), rng.integers(0, 14), p=[0.3, 0.3, 0.3, 0.05, 0.05]).astype(np.uint8)) for _ in range(n)), b""]


@pytest.mark.parametrize("places", [2, 1 << 10])
def test_many_words_at_once_are_those_of_the_merges(monkeypatch, places):
    monkeypatch.setattr(bpe, "PAIR_PLACES", places)  # pairs drive one another out
    monkeypatch.setattr(bpe, "MATCHES_AT_ONCE", places)
    own, words = bpe.Encoder(_spec()), _words(3000)
    ids, count = own.encode_words(words)
    cuts = np.concatenate([[0], np.cumsum(count)])
    for word, a, b in zip(words, cuts, cuts[1:]):
        assert ids[a:b].tolist() == _merged(own, word) == own.encode_word(word), word


def test_a_vocabulary_of_short_tokens_and_one_that_lacks_a_byte():
    said = json.loads(_spec())
    said["model"]["merges"] = ["a b"]
    said["model"]["vocab"] = {t: i for t, i in said["model"]["vocab"].items() if i < 256 or t == "ab"}
    own = bpe.Encoder(json.dumps(said).encode())
    for words in ([b"abbab"], [b""], [b"", b"b", b"ab"]):
        assert own.encode_words(words)[0].tolist() == [i for w in words for i in _merged(own, w)]
    del said["model"]["vocab"]["c"]
    own = bpe.Encoder(json.dumps(said).encode())
    with pytest.raises(ValueError):
        own.numbered(["ab", "cab"])
    assert own.numbered(["ba", "ab"]).tolist() == [0, 1] and own.flat.tolist() == _merged(own, b"ba") + _merged(own, b"ab")


def test_new_words_are_put_together_many_at_a_time():
    own, alone = bpe.Encoder(_spec()), []
    one = own.encode_word
    own.encode_word = lambda word: alone.append(word) or one(word)
    long = "abc" * 30
    words = ["abca", "bb", "abca", long, "ccab", "bb", "a"]
    at = own.numbered(words)
    assert alone == [long.encode()]  # short words make no call of their own
    assert at.tolist() == [0, 1, 0, 2, 3, 1, 4] and own.numbered(words).tolist() == at.tolist()
    assert [own.flat[own.starts[i]:own.starts[i + 1]].tolist() for i in at] == [_merged(own, w.encode()) for w in words]


def test_latin_texts_are_split_as_by_the_pattern():
    own, rng = bpe.Encoder(_spec()), np.random.default_rng(7)
    assert not isinstance(own.splitter("caf\xe9"), regex.Pattern) and isinstance(own.splitter("\u0142"), regex.Pattern)
    common = list(b" \n\t'sdtrevml09aB.") * 12
    for _ in range(3000):
        text = "".join(map(chr, rng.choice([*range(256), *common], 40)))
        assert own.splitter(text).findall(text) == regex.findall(PATTERN, text), text


def test_decimal_ids_come_from_one_table():
    own, ids = bpe.Encoder(_spec()), np.array([0, 7, 99, 100, 256, 261])
    digits, ends = own.decimal(ids)
    assert digits.tobytes() == b"0,7,99,100,256,261," and ends.tolist() == [2, 4, 7, 11, 15, 19]
