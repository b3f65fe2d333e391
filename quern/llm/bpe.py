"""Encoding with a public byte-level BPE as a tokenization automaton (problem 7).

``compile`` adds the merges one after another to an automaton over tokens. Its
states are the tokens a correct tokenization may end in; it starts with one
state for each byte and an arc between any two. The gadget of merge (u, v)

* makes a state uv, which may be followed by whatever v may be followed by,
* lets uv follow whatever u could follow while v could follow u,
* and takes the arc from u to v away.

The automaton then accepts exactly the correct tokenizations; as all of an
ordinary BPE's arcs into a state depend on merges made before, an arc's
existence is decided from the two states' gadgets alone and kept.

``Encoder`` makes it deterministic over bytes, state by state as words need
them: a state stands for what a prefix's tokenizations may still become, its
arc label is the last token of the prefix and where that began. Encoding a
pre-split word is one table look-up a byte; walking the labels back from the
end emits the ids.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how byte_bpe_50k splits texts in words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the tables that a worker keeps; a full table starts anew, results stay the same.
KEPT = 300_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Automaton:
    """The compiled merges: for each token its bytes, the two tokens it is made of, and its merge's number."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = vocabulary
        self.bytes_of = {i: b for b, i in vocabulary.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}  # arcs taken away, and by which merge
        self.arcs: dict[tuple[int, int], bool] = {}
        for n, (u, v) in enumerate(merges):
            self._gadget(n, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.longest = max(map(len, vocabulary), default=1)
        self.prefixes = {b[:i] for b in vocabulary for i in range(1, len(b) + 1)}

    def _gadget(self, n: int, u: int, v: int, uv: int) -> None:
        if uv not in self.rank:
            self.left[uv], self.right[uv], self.rank[uv] = u, v, n
        self.cut[(u, v)] = n

    def arc(self, s: int, t: int) -> bool:
        """Whether the state of token s has an arc for token t once all merges are in."""
        known = self.arcs.get((s, t))
        if known is None:
            if len(self.arcs) >= 10 * KEPT:
                self.arcs.clear()
            known = self.arcs[(s, t)] = self._arc(s, t)
        return known

    def _arc(self, s: int, t: int) -> bool:
        # Undo the later gadget of the two until both ends are bytes. The state of
        # uv has v's arcs as of its gadget, and uv follows what u followed then,
        # so a gadget that cut the arc between the ends counts if it came before
        # (on the right also in the same turn: a turn goes from left to right).
        limit = len(self.cut) + 1
        while True:
            cut = self.cut.get((s, t))
            if cut is not None and cut < limit:
                return False
            rs, rt = self.rank.get(s, -1), self.rank.get(t, -1)
            if rs < 0 and rt < 0:
                return True
            if rs > rt:
                limit, s = rs, self.right[s]
            else:
                limit, t = rt + 1, self.left[t]


def load(path: str) -> Automaton:
    """Read a tokenizers file (.json) of a byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letter = _byte_letters()
    raw = lambda s: bytes(letter[c] for c in s)
    vocabulary = {raw(s): i for s, i in model["vocab"].items() if all(c in letter for c in s) and not (s.startswith("<|") and s.endswith("|>"))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(vocabulary, [(raw(a), raw(b)) for a, b in pairs])


class Encoder:
    """Table-driven encoder of single words over the bytes' states."""

    def __init__(self, automaton: Automaton) -> None:
        self.a = automaton
        self._reset()

    def _reset(self) -> None:
        # A state: the live suffix (what a token may still begin with) and the
        # last tokens at its places; state 0 is the empty prefix.
        self.table: list[dict[int, int]] = [{}]
        self.label: list[tuple[int, int]] = [(-1, 0)]  # last token and its length
        self.keys: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.number: dict[tuple[bytes, tuple[int, ...]], int] = {self.keys[0]: 0}
        self.cached: dict[str, tuple[int, ...]] = {}

    def _step(self, state: int, byte: int) -> int:
        live, lasts = self.keys[state]  # lasts[i]: last token of the prefix that ends before live[i:]
        text, ids, arc = live + bytes([byte]), self.a.ids, self.a.arc
        token = size = -1
        for i in range(len(text)):
            t = ids.get(text[i:])
            if t is not None and (lasts[i] < 0 or arc(lasts[i], t)):
                token, size = t, len(text) - i
                break
        lasts = (*lasts, token)
        while text and text not in self.a.prefixes:
            text, lasts = text[1:], lasts[1:]
        key = (text, lasts)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.table.append({})
            self.label.append((token, size))
        self.table[state][byte] = to
        return to

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-split word."""
        known = self.cached.get(word)
        if known is not None:
            return known
        if len(self.keys) >= KEPT or len(self.cached) >= KEPT:
            self._reset()
        state, path, table = 0, [], self.table
        for byte in word.encode("utf-8", "surrogatepass"):
            to = table[state].get(byte)
            state = self._step(state, byte) if to is None else to
            path.append(state)
        out, at = [], len(path)
        while at:
            token, size = self.label[path[at - 1]]
            out.append(token)
            at -= size
        ids = self.cached[word] = tuple(reversed(out))
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        word, out = self.word, []
        for w in _splitter().findall(text):
            out += word(w)
        return out


_loaded: dict[str, Encoder] = {}


def _splitter():
    global _SPLIT
    if _SPLIT is None:
        import regex

        _SPLIT = regex.compile(PATTERN)
    return _SPLIT


_SPLIT = None


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; compiled once."""
    if path not in _loaded:
        _loaded[path] = Encoder(load(path))
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.json")


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` and the column ``out``: array<int> of token ids, without special tokens.

    Null and empty texts give the empty list; strings that look like special
    tokens are ordinary text. No shuffle but for inputs of too few splits.
    """
    return _encoded(df, text, out, path, lambda ids: pa.array(ids, pa.list_(pa.int32())), T.ArrayType(T.IntegerType()))


def with_token_count(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """``df`` and the column ``out``: the number of token ids, 0 for null and empty texts."""
    return _encoded(df, text, out, path, lambda ids: pa.array([len(x) for x in ids], pa.int32()), T.IntegerType())


def _encoded(df: DataFrame, text: str, out: str, path: str | None, make, kind: T.DataType) -> DataFrame:
    path = path or vocabulary_path()
    kept = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                n = part.num_columns - 1
                ids = [enc.encode(x) for x in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], make(ids)], names=[*kept, out])

    src = spread(df).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__q_text"))
    schema = src.drop("__q_text").schema.add(out, kind)
    return src.mapInArrow(run, schema)


def with_text(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` and the column ``out``: the text that the ids stand for, bytes joined and read as UTF-8; null ids give null."""
    path = path or vocabulary_path()
    kept = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path).a.bytes_of
        for b in batches:
            n = b.num_columns - 1
            texts = [None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], names=[*kept, out])

    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__q_ids"))
    return src.mapInArrow(run, src.drop("__q_ids").schema.add(out, T.StringType()))


def ranks(path: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file, for comparisons."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
