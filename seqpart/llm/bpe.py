"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton finds the longest token at each place of a word (tokens of one and two bytes are looked up in tables, and
new words are put together many at a time, each making one step at a time). The encoder walks the word with longest tokens;
a token stands only if it is compatible with the one before, that is if their bytes merged alone would give just these two.
Where none fits it steps back and marks the place as dead, so each place is left at most once and time is linear. The
result is that of the merges themselves.

Defined results: null and empty texts give no ids; a special token's string in a text gives its id, as the file declares it.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, slices, workers_ready

# Texts are worked on in parts of about so many words, which bounds memory for texts of any length.
WORDS_AT_ONCE = 100_000
# Words kept with their ids; beyond, the store starts anew.
STORED_WORDS = 250_000
# Pairs of tokens whose compatibility is remembered, and places of the table that answers for many pairs at once (a power of two).
STORED_PAIRS = 400_000
PAIR_PLACES = 1 << 19
# New words up to so many bytes are encoded so many at a time; longer ones, which would hold up the others, by themselves.
SHORT_WORD = 64
WORDS_TOGETHER = 20_000
MATCHES_AT_ONCE = 1_000_000
# A character that is no byte: no token reaches across it.
BORDER = "\u0100"

# Ranges of letters and numbers that Unicode 16.0 added, as the splitter knows them.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA)]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes as themselves, the rest from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def late_ranges() -> str:
    """Ranges of a character class that the file's splitter takes for neither letters nor numbers. It knows them up to Unicode 16.0,
    ``regex`` may know later ones: what neither this Python's older data nor 16.0 has counts as neither."""
    late = []
    for plane in range(0, sys.maxunicode + 1, 0x10000):  # a plane at a time, which bounds the memory
        every = "".join(chr(c) for c in range(plane, plane + 0x10000) if not 0xD800 <= c < 0xE000)
        late += [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every)
                 if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in UNICODE_16)]
    starts = [c for c, before in zip(late, [None, *late]) if before is None or c != before + 1]
    stops = [c for c, after in zip(late, [*late[1:], None]) if after is None or after != c + 1]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, stops))


@functools.cache
def latin_class(kind: str) -> str:
    """The Latin-1 characters of a character class that ``regex`` knows, as the inside of a class of ``re``."""
    return "".join(f"\\x{ord(c):02x}" for c in regex.findall(kind, "".join(map(chr, range(256)))))


def latin_splitter(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters, which ``re`` splits in half the time; its classes are those of ``regex``."""
    space, letters, numbers = (latin_class(kind) for kind in (r"\s", r"\p{L}", r"\p{N}"))
    return re.compile(
        pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(
            r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


class Numbers(dict):
    """Words and their numbers; a new word gets the next one when it is first asked for."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


class Encoder:
    """Tables of one vocabulary file. ``spec`` is the file's content."""

    def __init__(self, spec: bytes):
        said = json.loads(spec)
        letters = byte_letters()
        vocab: dict[str, int] = said["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.id_of = {self.token[i]: i for i in vocab.values()}
        # rank of a merge of two ids; what a token was merged from, and when
        self.rank: dict[tuple[int, int], int] = {}
        self.merges_of: dict[int, dict[int, int]] = {}  # the same by left id
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(said["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            self.merges_of.setdefault(a, {})[b] = r
            self.made[c] = (a, b, r)
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # tokens of one and of two bytes, which are looked up
        self.one, self.two = np.full(1 << 8, -1, np.int32), np.full(1 << 16, -1, np.int32)
        for i in vocab.values():
            t = self.token[i]
            if len(t) > 2:
                self.automaton.add_word(t.decode("latin-1"), i)
            elif t:
                (self.one if len(t) == 1 else self.two)[int.from_bytes(t)] = i
            self.shorter[i] = next((self.id_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id_of), -1)
        self.automaton.make_automaton()
        lengths = np.fromiter(map(len, self.token), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.lengths = lengths.tolist()
        self.size_of, self.shorter_of = lengths, np.array(self.shorter)  # the same for many words at once
        digits = [f"{i}," for i in range(size)]
        self.digit_offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, digits), np.int64, size))])
        self.digits = np.frombuffer("".join(digits).encode(), np.uint8)
        self.pairs: dict[int, bool] = {}  # by first id, shifted by 32 bits, and second
        self.pair_at = np.full(PAIR_PLACES, -1)  # pairs by place, the last one that asked; whether they are compatible
        self.pair_fits = np.zeros(PAIR_PLACES, bool)
        self.edges: tuple[dict, dict] = ({}, {})
        from public_tokenizers import PATTERN

        self.plain = regex.compile(PATTERN)
        self.latin = latin_splitter(PATTERN)
        self.late_ranges = late_ranges()
        self.late = regex.compile(f"[{self.late_ranges}]") if self.late_ranges else None
        self.pattern = PATTERN
        self.exact: regex.Pattern | None = None
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.clear()

    # --- one word -------------------------------------------------------------------------------------------------

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of ``token`` while it is merged, with the rank at which each is taken up."""
        known = self.edges[side].get(token)
        if known is None:
            known, at = [(token, float("inf"))], token
            while at in self.made:
                step = self.made[at]
                at = step[side]
                known.append((at, step[2]))
            self.edges[side][token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """No merge crosses the border of ``a`` and ``b``. Of equal ranks the left pair is merged first."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known, right = True, self._edge(b, 0)
            for x, taken_x in self._edge(a, 1):
                follow = self.merges_of.get(x)
                for y, taken_y in right if follow else ():
                    r = follow.get(y)
                    if r is not None and r < taken_x and r <= taken_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > STORED_PAIRS:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.id_of.get(word)
        if whole is not None:  # the longest token at the first place, with nothing before it
            return [whole]
        n = len(word)
        longest = memoryview(self.longest([word])[0])
        lengths, shorter, known = self.lengths, self.shorter, self.pairs
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, before = 0, longest[0] if n else -1, -1
        while at < n:
            end = at + lengths[token]
            if not dead[end]:
                fits = before < 0 or known.get(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    before = token
                    at, token = end, longest[end] if end < n else -1
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                before = out[-1] if out else -1
                at -= lengths[token]
        return out

    # --- many words -----------------------------------------------------------------------------------------------

    def compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        pair = a << 32 | b
        place = (a * 40503 + b) & (PAIR_PLACES - 1)
        fits = self.pair_fits[place]
        missing = np.flatnonzero(self.pair_at[place] != pair)
        if len(missing):
            asked, which = np.unique(pair[missing], return_inverse=True)
            told = np.fromiter((self.compatible(x >> 32, x & 0xFFFFFFFF) for x in asked.tolist()), bool, len(asked))
            fits[missing] = told[which]
            # of pairs that share a place one stays, with its own answer
            place = place[missing]
            self.pair_at[place] = pair[missing]
            same = self.pair_at[place] == pair[missing]
            self.pair_fits[place[same]] = fits[missing][same]
        return fits

    def longest(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(longest token at each byte of the words, -1 at the border after each word, place of each border)."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        raw = np.frombuffer(b"\0".join(words) + b"\0\0", np.uint8)
        two = self.two[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        two[ends - 1] = -1  # these would take in the border
        found = np.where(two < 0, self.one[raw[:-1]], two)
        text = BORDER.join([w.decode("latin-1") for w in words])
        said = itertools.chain.from_iterable(self.automaton.iter(text) if len(self.automaton) else ())
        # matches come by their end, so the last one of a place is its longest
        while len(matches := np.fromiter(itertools.islice(said, 2 * MATCHES_AT_ONCE), np.int64).reshape(-1, 2)):
            found[matches[:, 0] + 1 - self.size_of[matches[:, 1]]] = matches[:, 1]
        found[ends] = -1
        if np.count_nonzero(found < 0) > len(ends):
            raise ValueError("the vocabulary lacks tokens of single bytes")
        return found, ends

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each word): ``encode_word`` for many words, each making one step at a time.
        Places are those of the words' bytes put together, with a border after each word."""
        longest, ends = self.longest(words)
        starts = np.concatenate([[0], ends[:-1] + 1])
        # token that stands at a place, and the place of the token before it
        taken, previous, dead = np.full(len(longest), -1), np.full(len(longest), -1), np.zeros(len(longest), bool)
        last_of = np.full(len(words), -1)
        going = np.flatnonzero(starts < ends)
        at, last = starts[going], np.full(len(going), -1)
        token = longest[at]
        while len(going):
            end = at + self.size_of[token]
            fits = ~dead[end]
            asks = np.flatnonzero(fits & (last >= 0))
            fits[asks] = self.compatible_pairs(taken[last[asks]], token[asks])
            yes = np.flatnonzero(fits)
            place = at[yes]
            taken[place], previous[place] = token[yes], last[yes]
            last[yes], at[yes] = place, end[yes]
            token[yes] = longest[end[yes]]
            no = np.flatnonzero(~fits)
            token_no = self.shorter_of[token[no]]
            back = no[token_no < 0]
            token[no] = token_no
            if len(back):
                dead[at[back]] = True
                if (last[back] < 0).any():
                    raise ValueError("the vocabulary's tokens do not make up every word")
                at[back] = last[back]
                token[back], last[back] = taken[at[back]], previous[at[back]]
            done = at == ends[going]
            if done.any():
                last_of[going[done]] = last[done]
                stay = ~done
                going, at, token, last = going[stay], at[stay], token[stay], last[stay]
        # back from the last tokens
        stands, count = np.zeros(len(longest), bool), np.zeros(len(words), np.int64)
        going = np.flatnonzero(last_of >= 0)
        at = last_of[going]
        while len(going):
            stands[at] = True
            count[going] += 1
            at = previous[at]
            going, at = going[at >= 0], at[at >= 0]
        return taken[stands], count

    def clear(self) -> None:
        """Forget stored words. Entry i of ``starts`` is stored word i, its ids lie in ``flat``."""
        self.store = Numbers()
        self.flat = array("i")
        self.starts = array("i", [0])

    def _add(self, words: list[str]) -> None:
        """Store the ids of new words, in this order."""
        for first in range(0, len(words), WORDS_TOGETHER):
            some = words[first:first + WORDS_TOGETHER]
            raw = [w.encode() for w in some]
            alone = {k: [self.special[w]] if w in self.special else self.encode_word(r)
                     for k, (w, r) in enumerate(zip(some, raw)) if len(r) > SHORT_WORD or w in self.special}
            ids, count = self.encode_words([b"" if k in alone else r for k, r in enumerate(raw)])
            if alone:
                cuts = np.concatenate([[0], np.cumsum(count)]).tolist()
                ids = np.concatenate([np.array(alone[k]) if k in alone else ids[cuts[k]:cuts[k + 1]] for k in range(len(some))])
                count[list(alone)] = list(map(len, alone.values()))
            stops = len(self.flat) + np.cumsum(count)
            self.flat.frombytes(ids.astype(np.int32).tobytes())
            self.starts.frombytes(stops.astype(np.int32).tobytes())

    def words(self, text: str) -> Iterator[str]:
        """The text's words in order; strings of special tokens stand by themselves."""
        split = self.splitter(text)
        if self.marks is None or not any(s in text for s in self.special):
            return (m.group() for m in split.finditer(text))

        def parts() -> Iterator[str]:
            at = 0
            for m in self.marks.finditer(text):
                yield from (x.group() for x in split.finditer(text[at:m.start()]))
                yield m.group()
                at = m.end()
            yield from (x.group() for x in split.finditer(text[at:]))

        return parts()

    def splitter(self, text: str) -> re.Pattern | regex.Pattern:
        try:
            text.encode("latin-1")
            return self.latin
        except UnicodeEncodeError:
            if self.late is None or not self.late.search(text):
                return self.plain
            if self.exact is None:
                late = self.late_ranges
                self.exact = regex.compile(
                    self.pattern.replace(r"[^\s\p{L}\p{N}]", "\0").replace(r"\p{L}", rf"[\p{{L}}--[{late}]]").replace(
                        r"\p{N}", rf"[\p{{N}}--[{late}]]").replace("\0", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]"), regex.V1)
            return self.exact

    def numbered(self, words: list[str]) -> np.ndarray:
        """Stored numbers of words; new ones are encoded."""
        store, before = self.store, len(self.store)
        at = np.fromiter(map(store.__getitem__, words), np.int64, len(words))
        try:
            self._add(list(itertools.islice(reversed(store), len(store) - before))[::-1])
        except BaseException:
            self.clear()  # these words have numbers, but no ids
            raise
        return at

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """(words, number of the text each belongs to) in parts of bounded size."""
        words: list[str] = []
        owners: list[np.ndarray] = []
        for k, text in enumerate(texts):
            found = self.words(text) if len(text) > 1_000_000 or any(s in text for s in self.special) else iter(self.splitter(text).findall(text))
            while more := list(itertools.islice(found, WORDS_AT_ONCE)):
                words += more
                owners.append(np.full(len(more), k))
                if len(words) >= WORDS_AT_ONCE:
                    yield words, np.concatenate(owners)
                    words, owners = [], []
        if words:
            yield words, np.concatenate(owners)

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, text number of each id) in parts, in order."""
        for words, owner in self.parts(texts):
            if len(self.store) > STORED_WORDS:
                self.clear()
            at = self.numbered(words)
            starts = np.array(self.starts)
            sizes = starts[at + 1] - starts[at]
            yield np.array(self.flat)[ranges(starts[at].astype(np.int64), sizes)], np.repeat(owner, sizes)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the tokens one after the other, end of each token)."""
        return strung(self.bytes, self.offsets, ids)

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(digits of the ids one after the other, a comma after each, end of each id)."""
        return strung(self.digits, self.digit_offsets, ids)


def strung(pieces: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces asked for, one after the other, end of each); piece i lies from offset i to the next."""
    starts = offsets[which]
    sizes = offsets[which + 1] - starts
    return pieces[ranges(starts, sizes)], np.cumsum(sizes)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    total = int(sizes.sum())
    shift = starts - (np.cumsum(sizes) - sizes)
    return np.repeat(shift, sizes) + np.arange(total)


_encoders: dict[str, Encoder] = {}


def encoder(spec: Broadcast) -> Encoder:
    """The worker's encoder of a vocabulary, built once per process."""
    name = hashlib.sha256(spec.value).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(spec.value)
    return _encoders[name]


def release() -> None:
    """Forget the worker's encoders; the next task builds its own in under a second."""
    _encoders.clear()
    gc.collect()
    give_back_memory()


def vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file, read on the driver and sent to the workers. Its size is that of a vocabulary, not of the data."""
    workers_ready(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _cuts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    spec = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec)
        for batch in slices(batches):
            texts = batch.column(1).fill_null("").to_pylist()
            n = len(texts)
            count = np.zeros(n, np.int64)
            ids_sha, text_sha = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for ids, owner in own.encoded(texts):
                first, last = int(owner[0]), int(owner[-1])
                cut = np.searchsorted(owner, np.arange(first, last + 2))
                (said, said_ends), (raw, raw_ends) = own.decimal(ids), own.decode(ids)
                said_cut, raw_cut = (np.concatenate([[0], ends])[cut].tolist() for ends in (said_ends, raw_ends))
                said, raw = said.tobytes(), raw.tobytes()
                for k, n_ids in enumerate(np.diff(cut).tolist()):
                    if n_ids:
                        own_ids = said[said_cut[k]:said_cut[k + 1] - 1]
                        ids_sha[first + k].update(b"," + own_ids if count[first + k] else own_ids)
                        text_sha[first + k].update(raw[raw_cut[k]:raw_cut[k + 1]])
                        count[first + k] += n_ids
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array([h.hexdigest() for h in ids_sha]), pa.array([h.hexdigest() for h in text_sha])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every text."""
    spec = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec)
        for batch in slices(batches):
            texts = batch.column(1).fill_null("").to_pylist()
            found, count = [], np.zeros(len(texts), np.int64)
            for ids, owner in own.encoded(texts):
                found.append(ids)
                count += np.bincount(owner, minlength=len(texts))
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), lists], names=["doc_id", "n_tokens", "ids"])
        # Workers stay for stages that need their memory otherwise.
        del own
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    spec = vocabulary(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec)
        for batch in slices(batches):
            texts = [own.decode(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace") if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every text, without making ids."""
    spec = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec)
        for batch in slices(batches):
            texts = batch.column(1).fill_null("").to_pylist()
            count = np.zeros(len(texts))
            for words, owner in own.parts(texts):
                if len(own.store) > STORED_WORDS:
                    own.clear()
                at, starts = own.numbered(words), np.array(own.starts)
                count += np.bincount(owner, starts[at + 1] - starts[at], len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.astype(np.int64))], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")
