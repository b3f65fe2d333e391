"""Words and runs of words of texts in the consistent form, in numpy, a batch at a time."""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from quern.llm.canon import canonical, odd_characters

_WORD = re.compile(r"[^\W_]+")
#: Where one paragraph (sentence or line) ends.
_SENTENCE = re.compile(r"[.!?…:;]+(?=\s|$)|\n+")
MEMO = 500_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased, of the consistent form."""
    return _WORD.findall(canonical(text).lower()) if text else []


def paragraphs(text: str | None) -> list[str]:
    """The words of each paragraph that has any, parted by blanks."""
    return [" ".join(w) for part in _SENTENCE.split(canonical(text).lower()) if (w := _WORD.findall(part))] if text else []


_WORD_BIT, _SPACE_BIT, _END_BIT, _ODD_BIT = 1, 2, 4, 8
_CODES = ("utf-32-le", "surrogatepass")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is: in a word, white space, an end of a sentence, changed by the consistent form."""
    every, kinds = "".join(map(chr, range(sys.maxunicode + 1))), np.zeros(sys.maxunicode + 1, np.uint8)
    for bit, pattern in ((_WORD_BIT, _WORD), (_SPACE_BIT, r"\s+"), (_END_BIT, "[.!?…:;]+"), (_ODD_BIT, odd_characters() + "+")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] |= bit
    return kinds


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ``texts``, a line end after each, and where each begins (and the last ends)."""
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=start[1:])
    return np.frombuffer(("\n".join(texts) + "\n").encode(*_CODES), np.uint32), start


def paragraph_texts(texts: list[str | None]) -> list[str]:
    """``paragraphs`` of each text, parted by line ends, many texts at a time."""
    return list(chain.from_iterable(_paragraph_texts(texts[i : i + 256]) for i in range(0, len(texts), 256)))


def _paragraph_texts(texts: list[str | None]) -> list[str]:
    kinds, texts = _kinds(), [x or "" for x in texts]
    codes, start = _joined(texts)
    odd = np.logical_or.reduceat(kinds[codes] & _ODD_BIT != 0, start[:-1])
    codes, start = _joined([(canonical(x) if o else x).lower() for x, o in zip(texts, odd.tolist(), strict=True)])
    kind = kinds[codes]
    word, cut = kind & _WORD_BIT != 0, codes == 10
    cut[:-1] |= (kind[:-1] & _END_BIT != 0) & (kind[1:] & _SPACE_BIT != 0)
    # of the characters between two words the first stays, as a line end if a paragraph ends among them
    gap = ~word
    gap[1:] &= word[:-1]
    at, out = np.flatnonzero(gap), codes.copy()
    out[at] = np.where(np.logical_or.reduceat(cut, at), 10, 32)
    keep = word | gap
    to = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=to[1:])
    whole, to = out[keep].tobytes().decode(*_CODES), to[start].tolist()
    return [whole[a:b].strip(" \n") for a, b in zip(to, to[1:], strict=False)]


class WordHash(dict):
    """64-bit hashes of words, kept for the words seen most recently."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_batch(texts: list[str], memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` (words parted by white space) and the texts' offsets."""
    split = [t.split() for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=off[1:])
    get = memo.__getitem__
    return np.fromiter((get(w) for x in split for w in x), np.uint64, int(off[-1])), off


def hash_column(col: pa.Array, memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """``hash_batch`` of a column whose words are parted by one blank or line end each; a word of the column is looked up once."""
    if col.null_count or pc.any(pc.equal(col, "")).as_py():  # these would have an empty word
        return hash_batch([x or "" for x in col.to_pylist()], memo)
    split = pc.ascii_split_whitespace(col)
    off = np.zeros(len(col) + 1, np.int64)
    np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=off[1:])
    d = split.flatten().dictionary_encode()
    h = np.fromiter(map(memo.__getitem__, d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return h[d.indices.to_numpy(zero_copy_only=False)], off


def counter(h: np.ndarray, of: int) -> np.ndarray:
    """Which of ``of`` counters (a power of two) a hash belongs to."""
    return ((h >> np.uint64(20)) & np.uint64(of - 1)).astype(np.int64)


def shingle_batch(h: np.ndarray, off: np.ndarray, k: int, rank: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ``k`` words: (text index, hash, rank), by text, rank and hash.

    ``rank`` are counts of words and of runs, by ``counter``; a run's rank is
    the least of its own and its words' counts, an order that is the same for
    all texts. Without it the order is by hash.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    run = np.zeros(n, np.uint64)
    for i in range(k):
        run = (run ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    keep = doc[:n] == doc[k - 1 :]
    doc, run = doc[:n][keep], run[keep]
    r = np.zeros(len(run), np.int64)
    if rank is not None:
        c = rank[0][counter(h, len(rank[0]))]
        low = c[:n]
        for i in range(1, k):
            low = np.minimum(low, c[i : i + n])
        r = np.minimum(low[keep], rank[1][counter(run, len(rank[1]))]).astype(np.int64)
    # One key to sort by: text, rank (exact while small, then by its logarithm) and
    # the upper bits of the hash; where these don't tell two runs apart, all bits.
    level = np.minimum(np.where(r < 1024, r, 1024 + (32 * np.log2(np.maximum(r, 1) / 1024)).astype(np.int64)), 2047)
    o = None
    if len(off) <= 1 << 13:
        key = (doc.astype(np.uint64) << np.uint64(51)) | (level.astype(np.uint64) << np.uint64(40)) | (run >> np.uint64(24))
        o = np.argsort(key)
        if ((key[o[1:]] == key[o[:-1]]) & (run[o[1:]] != run[o[:-1]])).any():
            o = None
    if o is None:
        o = np.lexsort((run, level, doc))
    doc, run, r = doc[o], run[o], r[o]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], run[new], r[new]
