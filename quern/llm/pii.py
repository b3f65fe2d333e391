"""Personal information in free text by a skip-chain conditional random field (problem 1).

Tokens around a trigger (a group of digits, an at-sign, a family name before a
given one, a number beside a street word, spelled digits) are the nodes; every
other token is certainly outside. Labels are O and B-/I- of five kinds. Factors:

* one for each token: words, shapes, lexicons, the size and start of the number
  that the token is part of, signs and gaps in a window;
* one for each pair of neighbours; impossible changes of label are ruled out;
* skip factors: all mentions of the same thing in a document (the same digits
  however they are grouped, the same family and given name in any case and with
  or without accents, the same address of mail) are tied to one hub, a hidden
  variable for what the thing is, so all of them share their evidence, however
  many they are and wherever they stand.

Patterns only make the training labels: at most ``SAMPLE`` documents are labelled
by them, each also in a second form (lower case, words of context left out), so
that the model learns what a thing looks like and not only what stands beside
it. Token and chain weights are fitted together by the chain's likelihood, the
skip weights by the likelihood of each mention given the others. Decoding sees
no pattern: it passes messages over the loopy graph of all documents of a batch
at once, in numpy, until they stand still, and a last Viterbi pass along the chain
with the hubs' messages gives the labels; a find's bounds are its labels'.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.canon import canonical
from quern.session import spread

KINDS = ["email", "phone", "id_number", "address", "person_name"]
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: At most about so many texts are labelled by the patterns, and at most so many of them train the model.
CANDIDATES, SAMPLE = 6_000, 1_200
FEATURES = 1 << 17
_NONE = -1e4

# Frequent Vietnamese family names, and syllables of given and middle names.
SURNAMES = set(
    "nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đào đoàn vương trịnh đinh lâm mai triệu lương tô quách tạ hà thái châu kiều cao lưu phùng tăng nghiêm khúc tống la giang ninh tiêu văn thạch quan mạc kim âu bạch hàn trương diệp đàm chu".split()
)
GIVEN = set(
    "an ân ánh anh bách bảo bích bình cẩm châu chi chí chiến chiêu chiểu chinh chung công cúc cường đại đan đăng đạo đạt diễm điệp diệu đình doãn doanh đoan đông đức dung dũng dương duy duyên gia giang giao hà hải hân hằng hạnh hào hảo hậu hiền hiển hiệp hiếu hoa hoà hòa hoài hoan hoàng hồng huân huệ hùng hưng hương hường hữu huy huyền khải khang khánh khiêm khoa khôi khuê khương kiên kiệt kiều kim kỳ lam lâm lan lập lê liên linh loan lộc lợi long luân luận lực lựu lưu ly mai mẫn mận mạnh mi minh mộc mỹ my nam nga ngà ngân nghi nghị nghĩa ngoan ngọc nguyên nguyệt nhã nhân nhàn nhật nhi nhiên như nhung ninh nương oanh phát phi phong phú phúc phụng phương phượng quân quang quế quốc quý quỳ quyên quyền quyết quỳnh sam san sang sáng sen sơn sương tài tâm tấn tân thạch thái thắng thành thanh thảo thế thi thị thiên thiện thịnh thoa thoại thông thu thuận thuần thục thúc thương thủy thuỷ thùy thuỳ thúy thuý tiên tiến tín tính tình toại toán toàn trang trâm tri trí trinh trọng trúc trung trường tú tuấn tuân tuệ tùng tường tuyên tuyền tuyển tuyến tuyết định liễu liêu khiết uyên uyển vân văn vi viên viễn việt vinh vĩnh vũ vương vy vỹ xuân xuyến yên yến".split()
)


class _Plain(dict):
    """Each letter's plain one, made as needed."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        out = "d" if c in "đĐ" else ud.normalize("NFD", c)[0].lower()
        self[cp] = out = out if len(out) == 1 else out[0]
        return out


_PLAIN = _Plain()
_SUR_PLAIN, _GIVEN_PLAIN = {s.translate(_PLAIN) for s in SURNAMES}, {s.translate(_PLAIN) for s in GIVEN}

_INVISIBLE = "\u20e3­͏​-‏⁠﻿️"
_TOKEN = re.compile(rf"[\ẁ-ͯ{_INVISIBLE}]+|[^\w\s]")
_W, _GAP = r"[a-z]+", r"[ ,]{1,2}"
_NUM = r"k?\d{1,4}[a-z]?(?:/\d{1,4}[a-z]?)*"
_NAMES = rf"{_W}(?: {_W}){{0,3}}"
_WARD = r"(?:phuong|xa|quan|huyen|thi tran|thi xa|tp\.?|q\.|p\.|ward|district)"
_TAIL = rf"(?:,\s?(?:{_WARD} ?{_NAMES}|{_W}(?: {_W}){{0,3}} (?:ward|district|city)))*"
_ZEROS = str.maketrans("o", "0")
_DIGIT_WORDS = "khong|mot|hai|ba|bon|tu|nam|lam|sau|bay|tam|chin"
_LEFT_NOT = r"(?:stk|tai khoan|so tk|tk|ma don|ma van don|don hang|van don|so the)\W{0,3}(?:\w+\W){0,2}$"
_ID_LEFT = r"(?:cmnd|cmt|chung minh|cccd|can cuoc|dinh danh|ho chieu|passport|giay to|tam tru|identity)"

PATTERNS: list[tuple[str, re.Pattern[str]]] = [
    ("email", re.compile(r"(?<![\w@])[a-z0-9][\w.%+-]*(?:@| @ | ?[\[(] ?(?:at|a|@) ?[\])] ?| a cong )[a-z0-9][a-z0-9-]*(?:(?:\.| ?[\[(] ?(?:dot|cham|\.) ?[\])] ?| cham | dot )[a-z][a-z0-9-]*)+")),
    ("id_number", re.compile(r"(?<![\w+])[0o](?:[ .-]?[0-9o]){11}(?![\w])")),
    ("id_number", re.compile(rf"(?:{_ID_LEFT})[^\d\n]{{0,25}}?((?<!\w)[0-9o](?:[ .-]?[0-9o]){{8}})(?!\w)")),
    ("id_number", re.compile(r"(?<!\w)([a-z][0-9o]{7})(?!\w)")),
    ("phone", re.compile(r"(?<![\w.+@/-])(?:\+ ?84|84|\(\+84\))(?:[ .-]?[0-9o]){9,10}(?![\w@])")),
    ("phone", re.compile(r"(?<![\w.+@/-])\(?[0o](?:[ .()-]{0,2}[0-9o]){9,10}(?![\w@])")),
    ("phone", re.compile(rf"\bkhong(?:[ ,.-]{{1,2}}(?:{_DIGIT_WORDS})){{9,10}}\b")),
    ("address", re.compile(rf"(?<![\w.,/])(?:(?:so nha|so|nha so|nha|phong|can ho|can|lo|kiot)\.? ?)?{_NUM},? (?:(?:ngo|hem|ngach|kiet) {_NUM},? )+(?:(?:duong|pho|xom|thon) )?{_NAMES}{_TAIL}")),
    ("address", re.compile(rf"(?<![\w.,/])(?:(?:so nha|so|nha so|nha|phong|can ho|can|lo)\.? ?)?{_NUM},? (?:duong|d\.|pho|thon|xom|ap|khu pho|ngo|hem|chung cu|toa nha|toa|khu tap the) {_NAMES}{_TAIL}")),
    ("address", re.compile(rf"(?<![\w.,/]){_NUM},? {_W}(?: {_W}){{0,4}} (?:street|road|avenue|lane|alley|building|apartment)\b{_TAIL}")),
    ("address", re.compile(rf"(?<![\w.,/])(?:(?:so nha|so|nha so|nha)\.? ?)?{_NUM} {_W}(?: {_W}){{0,3}},\s?{_WARD} ?{_NAMES}{_TAIL}")),
    ("address", re.compile(rf"(?<![\w.,/])so nha {_NUM},? {_W} {_NAMES}{_TAIL}")),
]
_CUE = re.compile(r"\b(?:ai quen|quen|photo by|by|minh la|minh ten|ten la|toi la|em la|ky ten:?|ho so cua|cua|lien he|lien lac|thuoc ve|phu huynh|em|thay|co|dung ten|cam on|bi|ban|regards,?|gap|ong|ba|anh|chi|chu|bac|me|tac gia|nguoi nhan:?|chu tk:?)[ :,]*$")


_STREET = {"duong", "d", "pho", "hem", "ngo", "ngach", "kiet", "thon", "xom", "ap", "toa", "street", "road", "avenue", "lane", "alley", "building", "apartment", "ward", "district", "phuong", "xa", "quan", "huyen", "tran"}
_HOUSE = {"nha", "phong", "can", "lo", "kiot", "ho", "so"}
_SPELLED = set(_DIGIT_WORDS.split("|"))
_AT, _DIGIT, _FAMILY, _GIVEN, _PLACE, _WORDNUM, _COMMERCIAL = 1, 2, 4, 8, 16, 32, 64
_NUMBER = re.compile(r"[a-z]?[0-9o]*[0-9][0-9o]*|o+")


class _Tokens(dict):
    """What there is to know about a token by itself: its consistent form, plain and lower forms, shape, flags."""

    def __missing__(self, raw: str) -> tuple[str, str, str, str, int]:
        if len(self) >= 300_000:
            self.clear()
        w = raw if raw.isascii() else canonical(raw).replace("\u20e3", "")
        low, lower = w.translate(_PLAIN), w.lower()
        flags = (low == "@") * _AT | (bool(w) and low[0] in "0123456789" or bool(_NUMBER.fullmatch(low))) * _DIGIT | (low in _SPELLED) * _WORDNUM | (low in _STREET) * _PLACE | (low in ("cong", "at", "a")) * _COMMERCIAL
        flags |= (lower in SURNAMES or (w.isascii() and low in _SUR_PLAIN)) * _FAMILY | (lower in GIVEN or (w.isascii() and low in _GIVEN_PLAIN)) * _GIVEN
        out = self[raw] = (w, low, lower, _shape(w), int(flags))
        return out


_KNOWN = _Tokens()


def may_have_nodes(text: str) -> bool:
    """Whether ``Document.nodes`` may find any; a quick look that spares most texts the rest."""
    known = [k for k in map(_KNOWN.__getitem__, _TOKEN.findall(text)) if k[0]]
    flags = [k[4] for k in known]
    size, last, spelled, last_spelled = 0, -9, 0, -9
    for i, f in enumerate(flags):
        if not f & ~_GIVEN:
            continue
        if f & _AT or f & _FAMILY and flags[i + 1 : i + 2] and flags[i + 1] & _GIVEN:
            return True
        low = known[i][1]
        if f & _COMMERCIAL and i and (low == "cong" and known[i - 1][1] == "a" or known[i - 1][1] in "(["):
            return True
        if f & _DIGIT:
            joined = i - last <= 3 and low.translate(_ZEROS).isdigit() and all(k[1] in ".-()" for k in known[last + 1 : i])
            size, last = (size if joined else 0) + len(low), i
            if size >= 7 or any(x & _PLACE for x in flags[i + 1 : i + 7]) or i and known[i - 1][1] in _HOUSE and known[i - 1][1] != "so":
                return True
        if f & _WORDNUM:
            spelled = spelled + 1 if i - last_spelled <= 2 else 1
            last_spelled = i
            if spelled >= 5:
                return True
    return False


class Document:
    """A text's tokens, in the consistent form."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans, kept = [], []
        for m in _TOKEN.finditer(text):
            k = _KNOWN[m[0]]
            if k[0]:
                self.spans.append(m.span())
                kept.append(k)
        self.words, self.low, self.lower, self.shapes, self.flags = map(list, zip(*kept, strict=True)) if kept else ([], [], [], [], [])
        self.gap = [2] * len(kept)  # before each token: 0 none, 1 blanks, 2 a line end
        for i in range(1, len(kept)):
            between = text[self.spans[i - 1][1] : self.spans[i][0]]
            self.gap[i] = 2 if "\n" in between else 1 if between else 0

    @cached_property
    def joined(self) -> str:
        """The tokens as one string; ``at`` and ``end`` tell where each is."""
        parts, self.at, n = [], [], 0
        for i, w in enumerate(self.words):
            gap = ("", " ", "\n")[self.gap[i]] if i else ""
            parts += [gap, w]
            n += len(gap)
            self.at.append(n)
            n += len(w)
        self.end = [i + len(w) for i, w in zip(self.at, self.words, strict=True)]
        return "".join(parts)

    @cached_property
    def plain(self) -> str:
        return self.joined.translate(_PLAIN)

    @cached_property
    def caps(self) -> bool:
        letters = [w for w in self.words if w[0].isalpha()]
        return sum(w.isupper() for w in letters) > 0.8 * len(letters)

    def numbers(self) -> list[tuple[int, int, str]]:
        """(first token, end, digits) of groups of digits that may be one number."""
        out, i, n = [], 0, len(self.words)
        while i < n:
            if not (self.flags[i] & _DIGIT and _NUMBER.fullmatch(self.low[i])):
                i += 1
                continue
            digits, j = self.low[i], i + 1
            while j < n and len(digits) < 9:
                k = j
                while k < min(n, j + 2) and self.low[k] in (".", "-", "(", ")") and self.gap[k] < 2:
                    k += 1
                if not (k < n and self.gap[k] < 2 and self.low[k].translate(_ZEROS).isdigit()):
                    break
                digits += self.low[k]
                j = k + 1
            out.append((i, j, digits.translate(_ZEROS)))
            i = j
        return out

    def nodes(self) -> np.ndarray:
        """The tokens that may be part of a find, and some around them."""
        n = len(self.words)
        near = np.zeros(n, bool)

        def take(i: int, before: int, after: int) -> None:
            near[max(0, i - before) : i + after] = True

        some = [i for i, f in enumerate(self.flags) if f & ~_GIVEN]
        if any(self.flags[i] & _DIGIT for i in some):
            for i, j, digits in self.numbers():
                if len(digits) >= 7:
                    take(i, 4, j - i + 3)
                elif self.low[i][0] in "0123456789" and (any(f & _PLACE for f in self.flags[i + 1 : i + 7]) or i and self.low[i - 1] in _HOUSE and self.low[i - 1] != "so"):
                    take(i, 4, 20)
        spelled = 0
        for i in some:
            f = self.flags[i]
            if f & _AT or f & _COMMERCIAL and i and (self.low[i - 1] == "a" and self.low[i] == "cong" or self.low[i - 1] in "([" and i + 1 < n and self.low[i + 1] in ")]"):
                take(i, 10, 14)
            if f & _FAMILY and i + 1 < n and self.flags[i + 1] & _GIVEN and self.gap[i + 1] == 1:
                take(i, 3, 6)
            spelled = spelled + 1 if f & _WORDNUM and (not spelled or self.flags[i - 1] & _WORDNUM or self.low[i - 1] in ",.-") else int(bool(f & _WORDNUM))
            if spelled >= 5:
                take(i, 8, 9)
        return np.flatnonzero(near)

    def tokens(self, a: int, b: int) -> tuple[int, int]:
        return int(np.searchsorted(self.end, a, "right")), int(np.searchsorted(self.at, b, "left"))

    def matches(self) -> list[tuple[str, int, int]]:
        """(kind, first token, end) of the patterns, in order of trust; a later match may not overlap an earlier one."""
        flat = self.plain.replace("\n", " ")
        taken, out = np.zeros(len(self.words), bool), []

        def take(kind: str, a: int, b: int) -> None:
            i, j = self.tokens(a, b)
            if i < j and not taken[i:j].any():
                taken[i:j] = True
                out.append((kind, i, j))

        for kind, pattern in PATTERNS:
            for m in pattern.finditer(flat):
                a, b = m.span(1) if pattern.groups else m.span()
                found = flat[a:b]
                if kind in ("phone", "id_number") and (sum(c.isdigit() for c in found) < 6 and "khong" not in found or re.search(_LEFT_NOT, flat[max(0, a - 30) : a])):
                    continue
                if kind == "id_number" and found[0].isalpha() and found[0] != "o" and not self.joined[a].isupper():
                    continue
                if kind == "id_number" and found[:2] == "02" and not re.search(_ID_LEFT, flat[max(0, a - 40) : a]):
                    kind = "phone"
                if kind == "address":
                    b = a + len(self._trim(a, found))
                    if b <= a:
                        continue
                take(kind, a, b)
        for i in range(len(self.words) - 1):
            if not taken[i] and (n := self._name(i)):
                out.append(("person_name", i, i + n))
                taken[i : i + n] = True
        return sorted(out, key=lambda x: x[1])

    def _trim(self, a: int, found: str) -> str:
        """An address without the words after it that don't belong to a name: in a text with capitals it ends before the second small word."""
        original = self.joined[a : a + len(found)]
        if not any(c.isupper() for c in original) or self.caps:
            return found
        keep, good = 0, 0
        for m in re.finditer(r"\w+", original):
            w, p = m[0], found[m.start() : m.end()]
            ok = w[0].isupper() or w[0].isdigit() or p in ("so", "nha", "phong", "can", "ho", "lo", "ngo", "hem", "ngach", "kiet", "duong", "pho", "thon", "xom", "ap", "khu", "chung", "cu", "toa", "tap", "the", "phuong", "xa", "quan", "huyen", "thi", "tran", "tp", "q", "p")
            if not ok or ("\n" in original[keep : m.start()] and "," not in original[keep : m.start()]):
                break
            keep, good = m.end(), good + 1
        return found[:keep] if good >= 2 else ""

    def _name(self, i: int) -> int:
        """The number of tokens of a person's name that starts at token i, or 0."""
        if not self._family(i):
            return 0
        before = self.plain[max(0, self.at[i] - 24) : self.at[i]]
        if re.search(r"(?:duong|pho|ngo|hem|hieu|hang|shop|tiem|quan|ben|cua hang|street|@)[ ]?$", before):
            return 0
        first = self.words[i]
        capital = first[0].isupper() and not self.caps and not (len(first) > 1 and first.isupper())
        bare = first.isascii()
        n, known = 1, 0
        while n < 4 and i + n < len(self.words):
            j = i + n
            w = self.words[j]
            if self.joined[self.end[j - 1] : self.at[j]] != " " or not w.isalpha() or (capital and (not w[0].isupper() or len(w) > 1 and w.isupper())):
                break
            if not (self.lower[j] in GIVEN or self.lower[j] in SURNAMES or (w.isascii() and self.low[j] in _GIVEN_PLAIN)):
                break
            known += 1
            n += 1
            bare &= w.isascii()
        if capital:
            return n if known >= 1 else 0
        cue = bool(_CUE.search(before))
        if not cue and not (known >= 2 and not self.caps and all(self.words[j].isupper() for j in range(i, i + n))):
            return 0
        return n if known >= 2 or (known == 1 and not bare and self.lower[i] not in ("mai", "hồ", "văn", "la", "kim", "cao", "hà", "quan", "giang", "thạch", "lâm", "đào", "dương")) else 0

    def _family(self, i: int) -> bool:
        """Whether a token is a family name, written with its accents or without any."""
        return self.lower[i] in SURNAMES or (self.low[i] in _SUR_PLAIN and self.words[i].isascii())

    def _given(self, j: int) -> bool:
        return j < len(self.words) and (self.lower[j] in GIVEN or (self.low[j] in _GIVEN_PLAIN and self.words[j].isascii()))


def _shape(w: str) -> str:
    if w.isdigit() or len(w) > 5 and w.lower().translate(_ZEROS).isdigit():
        return f"d{min(len(w), 13)}"
    if not any(c.isalnum() for c in w):
        return w[:1]
    mixed = "m" if any(c.isdigit() for c in w) else ""
    return mixed + ("X" if w.isupper() else "Xx" if w[0].isupper() else "x")


class _Hash(dict):
    def __missing__(self, key: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[key] = xxhash.xxh3_64_intdigest(key) % FEATURES
        return h


_SLOT = _Hash()
#: The features of a node; those from CONTEXT on look at words beside it and are left out in the second form of a training text.
N_FEATURES, CONTEXT = 36, 24


def _features(d: Document, nodes: np.ndarray) -> np.ndarray:
    n = len(d.words)
    low, shapes, flags, gap = d.low, d.shapes, d.flags, d.gap
    number: dict[int, tuple[str, int, int]] = {}
    for i, j, digits in d.numbers():
        for x in range(i, j):
            number[x] = (digits, i, j)
    chunk = np.cumsum(np.asarray(gap) > 0)  # runs without blanks
    out = np.empty((len(nodes), N_FEATURES), np.int64)
    caps = d.caps
    at_sign = [i for i in range(n) if flags[i] & _AT or (flags[i] & _COMMERCIAL and i and (low[i] == "cong" and low[i - 1] == "a" or low[i - 1] in "([" and i + 1 < n and low[i + 1] in ")]"))]
    w = lambda i: (low[i] if not low[i].isdigit() else f"#{min(len(low[i]), 13)}") if 0 <= i < n else "^"
    s = lambda i: shapes[i] if 0 <= i < n else "^"
    g = lambda i: gap[i] if 0 <= i < n else 2

    def f(i: int) -> str:
        if not 0 <= i < n:
            return "^"
        x = flags[i]
        return ("F" if x & _FAMILY else "") + ("G" if x & _GIVEN else "") + ("P" if x & _PLACE else "") + ("N" if x & _WORDNUM else "") + ("D" if x & _DIGIT else "")

    for r, i in enumerate(nodes):
        i = int(i)
        up = "C" if caps else "A" if d.words[i].isupper() and len(d.words[i]) > 1 else "U" if d.words[i][:1].isupper() else "l"
        digits, a, e = number.get(i, ("", i, i + 1))
        lead = digits[:2] if not digits[:1].isalpha() else "L"
        size = min(len(digits), 14)
        left, right = next((i - x for x in reversed(at_sign) if x <= i), 99), next((x - i for x in at_sign if x >= i), 99)
        mail = f"{'L' if left < 12 else ''}{min(left, 3) if left < 12 else ''}{'R' if right < 12 else ''}{min(right, 3) if right < 12 else ''}{any(chunk[x] == chunk[i] for x in at_sign if abs(x - i) < 12)}"
        dots = [x for x in range(max(0, i - 8), min(n, i + 9)) if low[x] in (".", "dot", "cham")]
        street_l = next((k for k in range(1, 9) if i - k >= 0 and (flags[i - k] & _PLACE or low[i - k] in _HOUSE)), 0)
        street_r = next((k for k in range(1, 7) if i + k < n and flags[i + k] & _PLACE), 0)
        number_l = next((k for k in range(1, 9) if i - k >= 0 and low[i - k][0] in "0123456789"), 0)
        comma = next((k for k in range(1, 6) if i - k >= 0 and low[i - k] == ","), 0)
        glued = f"{g(i)}{g(i + 1)}"
        f0, f1, fb = f(i), f(i + 1), f(i - 1)
        keys = [
            "b", f"s{s(i)}", f"f{f0}{up}", f"ff{f0}|{f1}{up}", f"bf{fb}|{f0}{up}", f"fff{f(i - 2)}|{fb}|{f0}|{f1}", f"n{size}{lead}", f"ni{size}{min(i - a, 1)}{lead}", f"m{mail}{glued}", f"ml{left < 12}{bool(dots)}{s(i)}{glued}{right < 12}",
            f"mw{w(i) if low[i] in ('cong', 'a', 'at', 'dot', 'cham', '(', ')', '[', ']', '.', '-', '_', '+', '@') else ''}{left < 9}{right < 9}", f"sl{street_l}{up}{f0}", f"sr{street_r}{'D' if low[i][0] in '0123456789' else ''}", f"nl{number_l}{street_l}{up}", f"c{comma}{street_l > 0}{up}", f"w{w(i)}",
            f"g{glued}{s(i)}", f"s-{s(i - 1)}{s(i)}", f"s+{s(i)}{s(i + 1)}", f"nx{size}{lead}{s(a - 1) if a else '^'}{g(a)}{g(e)}", f"wn{f0}{f(i + 1)}{f(i + 2)}{f(i + 3)}", f"ws{w(i) if f0 or low[i] in _HOUSE else ''}{street_r}{street_l}", f"up{up}{s(i - 1)}{s(i + 1)}{number_l > 0}", f"wl{min(number_l, 2)}{min(comma, 2)}{street_l and w(i - street_l)}{up}",
            f"w-{w(i - 1)}", f"w+{w(i + 1)}", f"w--{w(i - 2)}", f"w++{w(i + 2)}", f"w-w{w(i - 1)}|{f0}{up}", f"nc{size}{w(a - 1)}", f"nd{size}{w(a - 2)}", f"ne{size}{w(a - 3)}", f"nf{size}{w(a - 2)}|{w(a - 1)}", f"ng{size}{w(e)}", f"wf{w(i - 1)}|{f0}|{f1}|{up}", f"ww{w(i - 2)}|{w(i - 1)}|{f0}",
        ]
        out[r] = [_SLOT[k] for k in keys]
    return out


def _mentions(d: Document, nodes: np.ndarray) -> list[tuple[str, int]]:
    """(what is mentioned, first token of the mention) among the nodes."""
    there, out = set(nodes.tolist()), []
    for i, _, digits in d.numbers():
        if len(digits) >= 7 and i in there:
            out.append((digits[2:] if digits.startswith("84") and len(digits) > 10 else digits.lstrip("0"), i))
    for i in nodes:
        i = int(i)
        if d.flags[i] & _FAMILY and i + 1 < len(d.words) and d.flags[i + 1] & _GIVEN and d.gap[i + 1] == 1:
            out.append((f"{d.low[i]} {d.low[i + 1]}", i))
        if d.low[i] == "@" and 0 < i < len(d.words) - 1:
            start = i - 1
            while start > 0 and (d.gap[start] == 0 and d.gap[start] < 1) and d.low[start - 1] not in (",", ";", ":", "(", "<"):
                start -= 1
            if start in there:
                out.append((f"{''.join(d.low[start:i])}@{d.low[i + 1]}", start))
    return out


class Graph:
    """The nodes, features, chain edges and hubs of documents, flat."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.token: list[int] = []
        self.feat: list[np.ndarray] = []
        self.gold: list[int] = []
        self.starts: list[int] = []
        self.hub: list[tuple[int, int]] = []  # (node, hub)
        self.hubs = 0

    def add(self, k: int, d: Document, nodes: np.ndarray, gold: np.ndarray | None = None, hide: float = 0.0, groups: dict[str, list[int]] | None = None) -> None:
        """hide: the share of the features of context that is left out, by chance; groups: gets the mentions by what they mention, to be tied later."""
        base = len(self.doc)
        at = {int(i): base + x for x, i in enumerate(nodes)}
        self.doc += [k] * len(nodes)
        self.token += nodes.tolist()
        feat = _features(d, nodes)
        if hide:
            feat[:, CONTEXT:] = np.where(np.random.default_rng(k).random((len(nodes), N_FEATURES - CONTEXT)) < hide, _SLOT["hidden"], feat[:, CONTEXT:])
        self.feat.append(feat)
        self.starts += [base + x for x in range(len(nodes)) if x == 0 or nodes[x - 1] != nodes[x] - 1]
        if gold is not None:
            self.gold += gold[nodes].tolist()
        own: dict[str, list[int]] = {} if groups is None else groups
        for what, i in _mentions(d, nodes):
            own.setdefault(what, []).append(at[i])
        if groups is None:
            self.tie(own)

    def tie(self, groups: dict[str, list[int]]) -> None:
        for mine in groups.values():
            if len(mine) > 1:
                self.hub += [(x, self.hubs) for x in mine]
                self.hubs += 1

    def steps(self) -> list[np.ndarray]:
        """The nodes by their place in their chain: all chains go forward together."""
        size = len(self.doc)
        start = np.zeros(size, bool)
        start[self.starts] = True
        first = np.maximum.accumulate(np.where(start, np.arange(size), 0))
        place = np.arange(size) - first
        order = np.argsort(place, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(place[order])) + 1)


class Model:
    """The trained factors: token weights (FEATURES x labels), chain scores (labels x labels), skip scores (label x the hub's kind)."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.weights, self.chain, self.skip = weights, chain, skip


def _legal() -> np.ndarray:
    """Scores that rule out I-x after anything but B-x or I-x."""
    n = len(LABELS)
    out = np.zeros((n, n))
    for b in range(n):
        if LABELS[b][0] == "I":
            out[:, b] = _NONE
            out[b, b] = out[b - 1, b] = 0
    return out


_FIRST = np.array([0.0 if x[0] != "I" else _NONE for x in LABELS])
#: The kind that a label belongs to: 0 outside, then KINDS.
_KIND = np.array([0, *(1 + i // 2 for i in range(len(LABELS) - 1))])


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def _marginals(z: np.ndarray, chain: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of all nodes and the expected counts of neighbouring labels, by forward and backward sums along the chains."""
    n = z.shape[1]
    fwd, bwd = np.zeros_like(z), np.zeros_like(z)
    for k, at in enumerate(steps):
        fwd[at] = z[at] + (_FIRST if k == 0 else _sum(fwd[at - 1][:, :, None] + chain[None], 1))
    for at in reversed(steps[1:]):
        bwd[at - 1] = _sum(chain[None] + (z[at] + bwd[at])[:, None, :], 2)
    both = fwd + bwd
    log_z = _sum(both, 1)
    pairs = np.zeros((n, n))
    if len(steps) > 1:
        at = np.concatenate(steps[1:])
        pairs = np.exp(fwd[at - 1][:, :, None] + chain[None] + (z[at] + bwd[at])[:, None, :] - log_z[at][:, None, None]).sum(axis=0)
    return both - log_z[:, None], pairs


def _golden(d: Document) -> np.ndarray:
    label = np.zeros(len(d.words), int)
    for kind, i, j in d.matches():
        b = 1 + 2 * KINDS.index(kind)
        label[i], label[i + 1 : j] = b, b + 1
    return label


def train(texts: list[str], rounds: int = 16) -> Model:
    """Weights from texts that the patterns label, each also in lower case or with its context hidden; a thing's mentions in both forms share a hub."""
    g, n = Graph(), len(LABELS)
    labelled = []
    for t in texts:
        d = Document(t)
        nodes = d.nodes()
        if len(nodes):
            gold = _golden(d)
            labelled.append((not gold.any(), len(labelled), t, d, nodes, gold))
    labelled = sorted(labelled, key=lambda x: x[:2])[:SAMPLE]  # those with a find first
    pairs = Graph()
    for k, (_, _, t, d, nodes, gold) in enumerate(labelled):
        g.add(k, d, nodes, gold)
        small = Document(t.lower())
        if len(small.words) != len(d.words):
            small = d
        g.add(k, d if k % 2 else small, nodes, gold, hide=(0.5, 0.5, 0.0, 0.5)[k % 4])
        if k < 600:
            groups: dict[str, list[int]] = {}
            pairs.add(k, d, nodes, gold, groups=groups)
            pairs.add(k, small, nodes, gold, hide=1.0, groups=groups)
            pairs.tie(groups)
    weights = np.zeros((FEATURES, n), np.float32)
    if not g.doc:
        weights[:, 0] = 1.0
        return Model(weights, _legal(), np.zeros((n, 1 + len(KINDS))))
    feats, gold = np.concatenate(g.feat), np.array(g.gold)
    steps, starts = g.steps(), np.array(g.starts)
    used, inv = np.unique(feats, return_inverse=True)
    inv = inv.reshape(feats.shape)
    order = np.argsort(inv.ravel(), kind="stable")
    rows = order // feats.shape[1]
    edge = np.searchsorted(inv.ravel()[order], np.arange(len(used)))
    target = np.eye(n)[gold]
    legal, chain = _legal(), np.zeros((n, n))
    inner = np.setdiff1d(np.arange(len(gold)), starts)
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    w, square = np.zeros((len(used), n), np.float32), np.full((len(used), n), 1e-4, np.float32)
    chain_square = np.full((n, n), 1e-4)
    for r in range(rounds):  # full-batch steps, scaled by feature
        z = np.zeros((len(gold), n), np.float32)
        for c in range(inv.shape[1]):
            z += w[inv[:, c]]
        log_p, joint = _marginals(z, (chain + legal).astype(np.float32), steps)
        e = (np.exp(log_p) - target).astype(np.float32)
        grad = np.add.reduceat(e[rows], edge, axis=0) + 0.05 * w
        square += grad * grad
        w -= 0.4 * grad / np.sqrt(square)
        grad = np.where(legal < 0, 0, joint - seen + 0.1 * chain)
        chain_square += grad * grad
        chain -= 0.3 * grad / np.sqrt(chain_square)
    weights[used] = w
    z = weights[np.concatenate(pairs.feat)].sum(axis=1)
    return Model(weights, chain + legal, _skip_weights(pairs, np.array(pairs.gold), _marginals(z, chain + legal, pairs.steps())[0]))


def _skip_weights(g: Graph, gold: np.ndarray, log_p: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Scores of (label, kind of the thing), by the likelihood of each mention's kind given what the others of its thing are.

    ``g`` has each text beside a form in lower case without context. Two numbers
    are learnt: what it counts that both are the same kind, and that both are none.
    """
    kinds = 1 + len(KINDS)
    p = np.stack([np.exp(log_p[:, _KIND == k]).sum(axis=1) for k in range(kinds)], axis=1)
    groups: dict[int, list[int]] = {}
    for x, h in g.hub:
        groups.setdefault(h, []).append(x)
    who, other = [], []
    for mine in groups.values():
        ks = _KIND[gold[mine]]
        for i, x in enumerate(mine):
            rest = np.delete(ks, i)
            who.append(x)
            other.append(int(np.bincount(rest, minlength=kinds).argmax()))
    a = np.array([1.0, 1.0])
    if who:
        logs, other, y = np.log(np.maximum(p[who], 1e-9)), np.array(other), _KIND[gold[who]]
        same = np.eye(kinds)[other]
        group = (other == 0).astype(int)
        for _ in range(rounds):
            z = logs + a[group][:, None] * same
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q = (q * same).sum(axis=1) / q.sum(axis=1)
            grad = np.bincount(group, (y == other) - q, 2) - 1.0 * (a - 1)
            a = np.clip(a + 0.5 * grad / (1 + np.bincount(group, minlength=2) * 0.25), 0, 6)
    score = np.zeros((len(LABELS), kinds))
    for k in range(kinds):
        score[_KIND == k, k] = a[1 if k == 0 else 0]
    return score


def decode(g: Graph, m: Model, most: int = 100) -> np.ndarray:
    """The label of each node: loopy max-product over chains and hubs until messages stand still, then Viterbi along the chains."""
    size = len(g.doc)
    own = m.weights[np.concatenate(g.feat)].sum(axis=1).astype(np.float64)
    own -= own.max(axis=1, keepdims=True)
    steps = g.steps()
    outside = np.zeros_like(own)
    if g.hub and m.skip.any():
        node, hub = np.array(g.hub).T
        docs = np.unique(np.array(g.doc)[node])
        live = np.flatnonzero(np.isin(np.array(g.doc), docs))  # only documents with hubs pass messages
        sub = [at[np.isin(at, live)] for at in steps]
        to_node, to_hub = np.zeros((len(node), own.shape[1])), np.zeros((len(node), m.skip.shape[1]))
        for _ in range(most):
            outside[:] = 0
            np.add.at(outside, node, to_node)
            best = _max_marginals(own + outside, m.chain, sub)
            new_hub = ((best[node] - to_node)[:, :, None] + m.skip[None]).max(axis=1)
            new_hub -= new_hub.max(axis=1, keepdims=True)
            total = np.zeros((g.hubs, m.skip.shape[1]))
            np.add.at(total, hub, new_hub)
            new_node = ((total[hub] - new_hub)[:, None, :] + m.skip[None]).max(axis=2)
            new_node -= new_node.max(axis=1, keepdims=True)
            moved = np.abs(new_node - to_node).max()
            to_node, to_hub = 0.5 * to_node + 0.5 * new_node, new_hub
            if moved < 1e-3:
                break
        outside[:] = 0
        np.add.at(outside, node, to_node)
    z = own + outside
    best, back = np.zeros_like(z), np.zeros(z.shape, int)
    for k, at in enumerate(steps):
        if k == 0:
            best[at] = z[at] + _FIRST
        else:
            s = best[at - 1][:, :, None] + m.chain[None]
            back[at] = s.argmax(axis=1)
            best[at] = s.max(axis=1) + z[at]
    ends = np.zeros(size, bool)
    ends[np.append(np.array(g.starts)[1:] - 1, size - 1)] = True
    out = np.zeros(size, int)
    for i in range(size - 1, -1, -1):
        out[i] = int(best[i].argmax()) if ends[i] else int(back[i + 1, out[i + 1]])
    return out


def _max_marginals(z: np.ndarray, chain: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    fwd, bwd = np.zeros_like(z), np.zeros_like(z)
    for k, at in enumerate(steps):
        if len(at):
            fwd[at] = z[at] + (_FIRST if k == 0 else (fwd[at - 1][:, :, None] + chain[None]).max(axis=1))
    for at in reversed(steps[1:]):
        if len(at):
            bwd[at - 1] = (chain[None] + (z[at] + bwd[at])[:, None, :]).max(axis=2)
    return fwd + bwd


def spans(texts: list[str | None], m: Model) -> list[list[tuple[str, int, int]]]:
    """For each text the (kind, start, end) of its personal information, as places in the text."""
    g, docs = Graph(), {}
    for k, t in enumerate(texts):
        if t and may_have_nodes(t):
            d = Document(t)
            nodes = d.nodes()
            if len(nodes):
                g.add(k, d, nodes)
                docs[k] = d
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not g.doc:
        return out
    marked: dict[int, list[list]] = {}
    for k, i, y in zip(g.doc, g.token, decode(g, m), strict=True):
        name, mine = LABELS[y], marked.setdefault(k, [])
        if name[0] == "B":
            mine.append([name[2:], i, i + 1])
        elif name[0] == "I" and mine and mine[-1][2] == i and mine[-1][0] == name[2:]:
            mine[-1][2] = i + 1
    for k, mine in marked.items():
        at = docs[k].spans
        out[k] = [(kind, at[a][0], at[b - 1][1]) for kind, a, b in mine]
    return out


_SAMPLED = r"\d[\d .()-]{5,}\d|@|＠|(?i)\b(?:ký tên|liên hệ|hồ sơ|phụ huynh|thuộc về|đứng tên|người nhận|photo by|regards|phường|phuong|số nhà|so nha|đường|hẻm|street)\b"


def fitted(df: DataFrame, text: str = "text") -> Model:
    """A model trained on at most about CANDIDATES of the texts that a trigger or a word of context stands in; chosen by hash, so the same in any partitioning."""
    t = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).where(F.col("t").rlike(_SAMPLED))
    n = t.count()
    part = min(1.0, CANDIDATES / max(n, 1))
    chosen = t.where(F.xxhash64("t") <= F.lit(min(2**63 - 1, int(-(2**63) + part * (2**64 - 1))))).distinct()
    return train(sorted(r.t for r in chosen.collect()))


def _run(df: DataFrame, text: str, m: Model, make, fields: list[tuple[str, T.DataType]], kept: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                texts = b.column(b.num_columns - 1).to_pylist()
                yield make(b, texts, spans(texts, shared.value))

    src = spread(df).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__q_text"))
    schema = src.drop("__q_text").schema
    for name, kind in fields:
        schema = schema.add(name, kind)
    return src.mapInArrow(run, schema)


def found(df: DataFrame, key: str = "id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(id, kind): one row per record and kind of personal information; null and blank texts have none."""
    m = model or fitted(df, text)

    def make(b: pa.RecordBatch, texts: list, s: list) -> pa.RecordBatch:
        rows = [(i, k) for i, x in enumerate(s) for k in sorted({y[0] for y in x})]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string())], names=[key, "kind"])

    return _run(df.select(key, text), text, m, make, [("kind", T.StringType())], [key]).distinct()


def redacted(df: DataFrame, text: str = "text", out: str = "redacted", model: Model | None = None) -> DataFrame:
    """``df`` and the column ``out``: the text with each find replaced by its kind's placeholder, the rest as it was."""
    m = model or fitted(df, text)
    kept = [c for c in df.columns if c.lower() != out.lower()]

    def make(b: pa.RecordBatch, texts: list, s: list) -> pa.RecordBatch:
        done = []
        for t, found_ in zip(texts, s, strict=True):
            for kind, a, e in reversed(found_):
                t = t[:a] + PLACEHOLDERS[kind] + t[e:]
            done.append(t)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(done, pa.string())], names=[*kept, out])

    return _run(df, text, m, make, [(out, T.StringType())], kept)
