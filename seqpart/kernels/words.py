"""Words of one Arrow batch: which of them another table may hold, and runs of them that share a minimizer."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

BITS = 1 << 22  # of the sieve; a fixed size, whatever the tables hold
CHARS = 1 << 20  # of texts laid end to end at once
RUN = 256  # words of one run at most
HELD = 1 << 23  # words that a task compares at once; more are dealt to files by their hash
BINS = 64  # of these files
PART_OF_OTHER = np.iinfo(np.int64).min  # stands for the owners of a set that lies in a larger one


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` codes from each position on, by doubling; equal words have equal hashes."""
    base = np.uint64(0x9E3779B97F4A7C15)
    power, block, out, done = base, codes.astype(np.uint64), None, 0
    width = 1
    while True:
        if k & width:
            out = block if out is None else out[:len(codes) - done - width + 1] * power + block[done:done + len(codes) - done - width + 1]
            done += width
        if done == k:
            break
        n = len(codes) - 2 * width + 1
        block = block[:n] * power + block[width:width + n]
        with np.errstate(over="ignore"):
            power, width = power * power, width * 2
    return _stirred(out)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def laid(texts: list[str], k: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, codes, first row and start of each row) of rows laid end to end with a NUL behind each, as many as ``CHARS`` allow; a
    single longer row is laid alone. Rows shorter than ``k`` are left out."""
    at, rows, held = 0, [], 0
    for row, text in enumerate([*texts, None]):
        if rows and (text is None or held + len(text) > CHARS):
            joined = "\0".join(texts[r] for r in rows) + "\0"
            sizes = np.array([len(texts[r]) + 1 for r in rows])
            yield joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.array(rows), np.cumsum(sizes) - sizes
            rows, held = [], 0
        if text is not None and len(text) >= k:
            rows.append(row)
            held += len(text) + 1


def _within(starts: np.ndarray, total: int, k: int) -> np.ndarray:
    """Whether the word from a position on lies inside one row."""
    ok = np.ones(total - k + 1, bool)
    for end in np.append(starts[1:], total):
        ok[max(0, end - k):end] = False
    return ok


def sieve_marks(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of a sieve of ``BITS`` bits that has the marks of all words of the texts."""
    marks = np.zeros(BITS // 64, np.uint64)
    for _, codes, _, starts in laid(texts, k):
        spot = np.unique(rolled(codes, k)[_within(starts, len(codes), k)] & np.uint64(BITS - 1))
        np.bitwise_or.at(marks, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    word = np.flatnonzero(marks)
    return word, marks[word].view(np.int64)


def sifted(texts: list[str], k: int, sieve: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], list[str]]]:
    """(row, 1-based position, word, symbol ahead or '') of the words whose mark is in the sieve, an array of ``BITS`` booleans."""
    for joined, codes, rows, starts in laid(texts, k):
        spot = (rolled(codes, k) & np.uint64(BITS - 1)).astype(np.int64)
        at = np.flatnonzero(sieve[spot] & _within(starts, len(codes), k))
        own = np.searchsorted(starts, at, side="right") - 1
        pos = at - starts[own]
        yield rows[own], pos + 1, [joined[i:i + k] for i in at.tolist()], [joined[i - 1:i] if p else "" for i, p in zip(at.tolist(), pos.tolist())]


def _cuts(codes: np.ndarray, starts: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, begin, end) of runs of words of length ``k``, by the positions at which their words begin."""
    least, width, w = rolled(codes, m), 1, k - m + 1
    while width < w:  # minima of windows that grow to w
        step = min(width, w - width)
        least, width = np.minimum(least[:len(least) - step], least[step:]), width + step
    ok = _within(starts, len(codes), k)
    new = np.ones(len(ok), bool)
    new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    new[::RUN] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(ok))
    begin, end = begin[ok[begin]], end[ok[begin]]
    return least[begin], begin, end


def runs(texts: list[str], k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(row, bucket, piece): pieces that together hold each word of length ``k`` at each of its positions. ``bucket`` is the least hash
    of the ``m``-words of each of the piece's words, so equal words lie in equal buckets."""
    for joined, codes, rows, starts in laid(texts, k):
        bucket, begin, end = _cuts(codes, starts, k, m)
        own = np.searchsorted(starts, begin, side="right") - 1
        yield rows[own], bucket.view(np.int64), [joined[a:b + k - 1] for a, b in zip(begin.tolist(), end.tolist())]


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + sizes[i] - 1`` of every i, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def dealt_runs(texts: list[str], k: int, m: int, parts: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[bytes], list[bytes]]]:
    """The pieces of ``runs`` by the part that their bucket falls to: (part, rows of its pieces, their sizes, their codes). Codes
    take a byte each, or four where one needs them."""
    for _, codes, rows, starts in laid(texts, k):
        bucket, begin, end = _cuts(codes, starts, k, m)
        if not len(begin):
            continue
        part = (_stirred(bucket) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, begin, sizes = part[order], begin[order], (end - begin)[order] + k - 1
        own = rows[np.searchsorted(starts, begin, side="right") - 1]
        flat = (codes.astype(np.uint8) if codes.max() < 256 else codes)[_ragged(begin, sizes)]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        places = list(zip(cut.tolist(), np.append(cut[1:], len(part)).tolist()))
        until = np.append(0, np.cumsum(sizes))
        small = sizes.astype(np.int32)
        yield (part[cut], [own[a:b] for a, b in places], [small[a:b].tobytes() for a, b in places],
               [flat[until[a]:until[b]].tobytes() for a, b in places])


def _second(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of the words at some positions, symbol by symbol."""
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = _stirred(out * np.uint64(0x9E3779B97F4A7C15) + codes[at + i])
    return out


def _named(first: np.ndarray, second: np.ndarray, owner: np.ndarray, spot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(owner, n, x, s), without repeats, of words that several owners have: the size of a word's set of owners and the xor and sum of
    two hashes over it. Words are equal where both hashes are.

    With ``spot``, the place of each word in the pieces (words next to each other in a piece have places next to each other, other words
    don't), sets that lie in a larger one are told by a single row with owner ``PART_OF_OTHER``. It is found where a word always has the
    same word next to it, on the left or on the right, and that word has more owners.
    """
    order = np.lexsort((owner, second, first))
    first, second, owner = first[order], second[order], owner[order]
    word = np.ones(len(owner), bool)
    word[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    once = word.copy()
    once[1:] |= owner[1:] != owner[:-1]
    begin = np.flatnonzero(word[once])
    n = np.diff(np.append(begin, once.sum()))
    inside = np.zeros(len(n), bool)
    if spot is not None and len(n):
        spot, group, heads = spot[order], np.cumsum(word) - 1, np.flatnonzero(word)
        by_spot = np.argsort(spot)
        groups, next_to = group[by_spot], np.diff(spot[by_spot]) == 1
        for left in (True, False):
            beside = np.full(len(spot), -1)
            if left:
                beside[by_spot[1:][next_to]] = groups[:-1][next_to]
            else:
                beside[by_spot[:-1][next_to]] = groups[1:][next_to]
            least = np.minimum.reduceat(beside, heads)
            inside |= (least >= 0) & (least == np.maximum.reduceat(beside, heads)) & (n[least] > n)
    owner = owner[once]
    kept = n > 1
    owner, inside, n = owner[np.repeat(kept, n)], inside[kept], n[kept]
    if not len(n):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    begin = np.cumsum(n) - n
    mark = _stirred(_stirred(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    x = np.bitwise_xor.reduceat(mark, begin).view(np.int64)
    s = np.add.reduceat(_stirred(_stirred(mark + np.uint64(0x9E3779B97F4A7C15))), begin).view(np.int64)
    # a set is taken once, and told by one row where one of its words says that it lies in another
    order = np.lexsort((~inside, s, x, n))
    new = np.ones(len(n), bool)
    new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (n, x, s)], axis=0)
    taken = order[new]
    told = np.where(inside[taken], 1, n[taken])
    at = _ragged(begin[taken], told)
    return (np.where(np.repeat(inside[taken], told), PART_OF_OTHER, owner[at]), *(np.repeat(v[taken], told) for v in (n, x, s)))


def shared_words(rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, maximal: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """``_named`` of the words of all pieces, given as (owner of each, size of each, their codes one after the other); equal words must
    all be here. Up to ``HELD`` words are compared at once, more go to files by their first hash, where neighbours are not looked at."""
    held, words, hashes = [], 0, []
    with tempfile.TemporaryDirectory() as folder:
        bins = None

        def hashed(sizes, codes):
            n = sizes - (k - 1)
            return n, _ragged(np.cumsum(sizes) - sizes, n)

        def deal(owner, sizes, codes, first):
            n, at = hashed(sizes, codes)
            table = np.stack([first, _second(codes, at, k), np.repeat(owner, n).view(np.uint64)], axis=1)
            slot = (first >> np.uint64(58)).astype(np.int64)
            for b in np.unique(slot).tolist():
                table[slot == b].tofile(bins[b])

        try:
            for owner, sizes, codes in rows:
                first = rolled(codes, k)[hashed(sizes, codes)[1]]
                if bins is None and words + len(first) > HELD:
                    bins = [open(os.path.join(folder, str(b)), "wb+") for b in range(BINS)]
                    for piece, own in zip(held, hashes):
                        deal(*piece, own)
                    held, hashes = [], []
                if bins is not None:
                    deal(owner, sizes, codes, first)
                    continue
                held.append((owner, sizes, codes))
                hashes.append(first)
                words += len(first)
            for b in bins or ():
                b.seek(0)
                table = np.fromfile(b, np.uint64).reshape(-1, 3)
                yield _named(table[:, 0], table[:, 1], table[:, 2].view(np.int64))
        finally:
            for b in bins or ():
                b.close()
    if not held:
        return
    first = np.concatenate(hashes)
    order = np.argsort(first)
    near = first[order]
    same = near[1:] == near[:-1]
    met = np.zeros(len(near), bool)
    met[1:] |= same
    met[:-1] |= same
    order, near = order[met], near[met]
    del first, same, met
    owner, sizes = (np.concatenate([piece[i] for piece in held]) for i in (0, 1))
    kind = np.uint8 if all(codes.dtype == np.uint8 for *_, codes in held) else np.uint32
    codes = np.concatenate([codes.astype(kind, copy=False) for *_, codes in held])
    n = sizes - (k - 1)
    piece = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
    at = (np.cumsum(sizes) - sizes - np.cumsum(n) + n)[piece] + order
    yield _named(near, _second(codes, at, k), owner[piece], order + piece if maximal else None)
