"""Scoring posts for abusive, hateful or sexual content by weak supervision (problem 5).

Voters are lexicons and patterns over the plain form of a text (one form of
characters, no accents, tricks like dots between letters undone). They combine
who is spoken of with what is said, so most of them are often wrong: each votes
1 (unsafe), 0 (safe) or abstains. A model of the reviewed texts votes too, on a
reviewed text one that hasn't seen it; reviewers' marks are the last voter. The
counts of all vote vectors of the whole table are the data of a generative label
model: the true label is hidden, a vote depends on it and on one other vote, so
that voters that say the same thing aren't counted as independent evidence. It
is fitted by expectation-maximisation, first without correlations, then with the
tree of the strongest ones, and tells how far each voter can be trusted. Its
posteriors train a linear classifier on at most ``SAMPLE`` texts of each kind, and
that scores every text.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.canon import canonical
from quern.llm.linear import Sparse, fit_scaled, sigmoid
from quern.llm.words import WordHash, hash_batch
from quern.session import spread, stored

#: At most about so many texts of each kind (voted on or not) train the classifier.
SAMPLE = 12_000
FEATURES = 1 << 17
SCALE = 0.25

_LEET = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"[^\W\d_]+[013457@$]+[^\W_]*|[013457@$]+[^\W\d_][^\W_]*")
_INSIDE = re.compile(r"(?<=[^\W_])['’.*_·~-](?=[^\W_])|(?<=[^\W\d_])[’'`*]+")
_SPACED = re.compile(r"\b(?:[^\W\d_] ){2,}[^\W\d_]\b")
_DOUBLE = re.compile(r"([^\W\d_])\1+")
_WORD = re.compile(r"[^\W_]+")


class _Chunks(dict):
    """The plain words of a run of characters without blanks."""

    def __missing__(self, chunk: str) -> str:
        if len(self) >= 300_000:
            self.clear()
        t = ud.normalize("NFD", chunk.replace("đ", "d"))
        t = _INSIDE.sub("", "".join(c for c in t if not ud.combining(c)))
        t = _MIXED.sub(lambda m: m[0] if re.fullmatch(r"\d+[a-z]?|\d+(?:km|kg|tr|k|h|d)\d*", m[0]) else m[0].translate(_LEET), t)
        out = self[chunk] = " ".join(_WORD.findall(_DOUBLE.sub(r"\1", t)))
        return out


_PLAIN = _Chunks()


def plain(text: str | None) -> str:
    """Lower-case words without accents, doubled letters and the usual disguises (signs inside words, digits for letters, letters set apart)."""
    t = " ".join(filter(None, map(_PLAIN.__getitem__, canonical(text or "").lower().split())))
    return _SPACED.sub(lambda m: _DOUBLE.sub(r"\1", m[0].replace(" ", "")), t)


# Lexicons, in plain form. Voters are made of these: who is spoken of, and what is said.
_YOU, _I = "may|mai|m|mi|chung may|tui may|tui bay|bon may|lu may|nha may|you", "tao|tau|t|bo may"
_KIND = "do|thang|con|lu|bon|quan|loai|tui|dam|e|ca lu|phuong"
_PEOPLE = "lu|bon|dam|tui|dan|may ong|may ba|nhung ke|nhung dua|ca lu|al|those"
_VILE = (
    "ngu hoc|ngu dot|ngu si|dan don|khon nan|khon kiep|khon|dau dat|vo hoc|vo lai|suc vat|suc sinh|bo di|rac ruoi|rac|mat day|mat lon|mat cho|oc cho|oc lon|oc heo|dau bo|an hai|an bam|dot nat|cho ma|cho dai|cho chet|lua dao|ban thiu|dang ghet|"
    "dien|hen|bien thai|tam than|than kinh|hu hong|mat net|ti tien|ha cap|de tien|vo dung|dot|beo|lun|xau xi"
)
_STRONG = "ngu hoc|ngu dot|khon nan|khon kiep|dau dat|vo hoc|suc vat|suc sinh|rac ruoi|mat lon|oc cho|oc lon|oc heo|an hai|cho ma|cho dai|ti tien|ha cap|de tien|con di|di diem|mat day"
_BEASTS = "sau bo|suc vat|suc sinh|ha dang|rac ruoi|vermin|scum|ky sinh|ruoi nhang|trash|garbage|loai vat|cho cai"
_LOW = f"{_BEASTS}|ban thiu|an cap|luoi bieng|luoi nhac|vo on|pha nat|pha hoai|xui|benh hoan|hau nguoi|khong xung|khong dang|thap kem|man ro|tranh nhu dich|ton com|di hop|dirty|thieves|lazy"
_HIT = "dap|dam|chem|giet|phang|dot|bop co|xien|vo mat|dap chet|danh|ban|kil|beat|punch"
_SEX = "nude|nudes|sex|sexy|porn|x{2,}|gai goi|lam tinh|kich duc|khoa than|dit|bu cu|lo hang|phim cap ba|khong che|dam dang|dam duc|thu dam|quay len|clip nong|cave|mai dam|ngoai tinh|hot girl|them lam|tan giuong|bao phe|len dinh"
_ENGLISH = "moron|idiot|stupid|dumb|filthy|bitch|whore|slut|bastard|ashole|fuck|cunt|retard|scum|trash|garbage|loser|worthles|nobody wants you|shut up|piece of"
_MORE = r"(?: \w+){0,%d}"


def _near(left: str, right: str, gap: int) -> str:
    """Both in this order with at most ``gap`` words between."""
    return rf"\b(?:{left}){_MORE % gap} (?:{right})\b"


def _heads(phrases: str) -> frozenset[str]:
    """The first one or two words of each phrase."""
    return frozenset(" ".join(x.split()[:2]) for x in phrases.split("|"))


def _firsts(phrases: str) -> str:
    return " ".join(dict.fromkeys(x.split()[0] for x in phrases.split("|")))


def _lasts(phrases: str) -> str:
    return " ".join(dict.fromkeys(x.split()[-1] for x in phrases.split("|")))


#: Voters for unsafe: what they look for in the plain form, and what must be there to look at all: one of these phrases (of at most two words), or one word of each of these sets (parted by |).
UNSAFE: dict[str, tuple[str, str | frozenset[str]]] = {
    "vile_person": (rf"\b(?:{_KIND}) (?:{_VILE})\b(?! thoai| tu| tich| may| nuoi)", f"{_firsts(_KIND)}|{_firsts(_VILE)}|{_lasts(_VILE)}"),
    "vile_word": (rf"\b(?:{_STRONG})\b(?! nuoi)", _heads(_STRONG)),
    "ngu": (r"\b(?:lu|bon|thang|do|qua|sao|dung la|toan|vua) ngu\b(?! di| roi| ngon| ngay| truong| trua| muon| lai| chut| som)|\bngu (?:nhu|vl|vai|qua|the|ve|lam|bm|bo)\b", "ngu"),
    "you_are": (rf"\b(?:{_YOU}) (?:dung |chi |cung |qua |van )*(?:la|nhu|are) (?!ai\b|gi\b)(?:do|thang|con|lu|loai|cai|mot|thu|worthles|a|so|mat|oc|an)\b", "may mai m mi bay you|la nhu are|do thang con lu loai cai mot thu worthles a so mat oc an"),
    "like_you": (rf"\b(?:mat|ban mat|cai mat|loai|thu|hang)(?: nhu)? (?:{_YOU})\b|\b(?:ra|de ra|day) (?:{_YOU})\b|\b(?:cua|voi) (?:{_YOU}) (?:chi|toan|ma|di)\b", "may mai m mi bay|mat loai thu hang ra day cua voi"),
    "parents": (r"\b(?:bo|bu|cha|me|ong|ba|thay) (?:me |bo )?(?:may|mai|no|tui may)\b|\b(?:de ra|sinh ra)" + _MORE % 3 + r" (?:phi|uong|ngu|nhuc|de)\b|\bngu ve\b|\b(?:day|nuoi|thay) (?:\w+ ){0,3}(?:bu me|bo me|me cha)\b", "bo bu cha me ong ba thay de ra sinh ngu day nuoi|may mai no phi uong ngu nhuc de ve bu bo cha"),
    "shut_up": (r"\b(?:cam|ngam|khep|bit|khoa|ngam cai|mo)" + _MORE % 1 + r" (?:mom|mieng|hong)\b|\b(?:cut|kut|xeo|bien) (?:di|ve|khoi|ngay|xeo|mau)\b|\bim (?:di|mom|mieng|ngay)\b|\bshut (?:up|your|the)\b|\bget (?:lost|out)\b|\bfuck of\b", "mom mieng hong cut kut xeo bien im shut get fuck|cam ngam khep bit khoa mo di ve khoi ngay xeo mau mom mieng up your the lost out of"),
    "silence_who": (_near("ai hoi|ai cho|ai khien|ai muon|mien", "len tieng|noi|ma noi|xen", 3), "hoi cho khien muon mien|tieng noi xen"),
    "violence": (rf"\b(?:{_I}) (?:\w+ ){{0,3}}(?:{_HIT})\b|\b(?:{_HIT}) (?:vo |chet |nat |gay )+(?:mat|mom|rang|xuong|{_YOU})\b|\b(?:{_HIT}) (?:{_YOU})\b", f"{_HIT.replace('|', ' ')}|tao tau t bo vo chet nat gay may mai m mi bay you"),
    "threat": (rf"\b(?:biet tay|biet nha|biet mat|dung thach|dung trach|coi chung|chet voi|toi so|xong doi|quan tai|tim (?:toi|den) nha|toi (?:dot|pha|dap|tan nha)|gap (?:{_I})|(?:{_I}) (?:\w+ ){{0,3}}(?:toi nha|quan tai|biet))\b|\bngoai duong\b.{{0,20}}\bxe\b", "biet dung coi chet toi xong quan tim gap ngoai|tay nha mat thach trach chung voi so doi tai dot pha dap tao tau t biet duong chet"),
    "death_wish": (r"\b(?:nen|di|cho|ma|cu|thi|uoc|sao khong|ra duong)" + _MORE % 2 + r" (?:chet|nhay cau|tu tu|tu sat|nhay lau|bi xe|bi danh|die|kil)\b|\bchet (?:quach|di|doi|het|mat|giam|co)\b|\b(?:kil|hang) (?:yourself|urself)\b|\bgo die\b", "chet nhay tu bi die kil hang|nen di cho ma cu thi uoc sao ra quach doi het mat giam co yourself urself go"),
    "group_low": (_near(_PEOPLE, _LOW, 6), f"lu bon dam tui dan ong ba ke dua al those|{_firsts(_LOW)}|{_lasts(_LOW)}"),
    "low_group": (_near(f"{_LOW}|ghet|khinh|cay|dung thue|dung noi|dung choi|cam cua|tay chay|uoc gi|cu thay|cu gap|dinh toi", _PEOPLE, 4), f"lu bon dam tui dan ong ba ke dua al those|{_firsts(_LOW)} ghet khinh cay dung cam tay uoc cu dinh"),
    "expel": (r"\b(?:duoi|nhot|tong|cam cua|tieu diet|bien mat|quet sach|kick|deport)" + _MORE % 3 + r" (?:het|khoi|ve nuoc|out|lai)\b", "duoi nhot tong cam diet mat sach kick deport|het khoi nuoc out lai"),
    "beasts": (rf"\b(?:la|nhu|toan|lu|loai|giong|are|you|di|al|hon|dung la) (?:\w+ ){{0,2}}(?:{_BEASTS})\b", f"{_firsts(_BEASTS)}|{_lasts(_BEASTS)}|la nhu toan lu loai giong are you di al hon"),
    "inferior": (r"\b(?:sinh ra|sinh|de)" + _MORE % 2 + r" (?:hau|phuc vu|lam no|de hau)\b|\bkhong (?:xung|dang) (?:lam|song|la)\b|\b(?:doi|bay dat)" + _MORE % 2 + r" (?:binh dang|quyen|bang vai)\b|\bbang vai\b", "hau no xung dang quyen vai phuc|sinh de khong doi bay bang"),
    "useless": (r"\b(?:ton (?:com|oxy|dat|gao)|phi (?:com|cong|gao)|chi ton|vo dung|vo tich su|co ich|an hai|chi biet an|worthles|useles|nobody wants)\b|\b(?:uong|la) phi\b|\bnuoi" + _MORE % 3 + r" (?:ich|hon)\b|\bnao (?:de|khong|cua)\b", "ton phi vo co hai an worthles useles nobody nuoi nao|com oxy dat gao cong chi dung su ich an worthles useles nobody la uong hon de khong cua"),
    "disdain": (r"\b(?:khinh|nhuc nha|kinh tom|ngua mat|ghe tom|thoi nat|ma cung (?:viet|noi|doi|dang|choi)|ma doi)\b|\bcai mat nhu\b|\bnhu cai\b", "khinh nhuc kinh ngua ghe thoi ma cai|khinh nha tom mat nat cung doi mat nhu"),
    "sex_word": (rf"\b(?:{_SEX})\b", _heads(_SEX) | {"xx"}),
    "sex_body": (r"\b(?:nguc|mong|vu|dui)" + _MORE % 1 + r" (?:to|khung|cong|bu|tron)\b", "nguc mong vu dui|to khung cong bu tron"),
    "sex_want": (r"\b(?:them|muon|day|coi|xem|gui|share|send|quay|chat)" + _MORE % 4 + r" (?:lam tinh|nudes?|vu|clip|sex|phang|x|nhay|anh sung|cho xem|de ra|vao le)\b", "them muon day coi xem gui share send quay chat|tinh nude nudes vu clip sex phang x nhay sung xem de le"),
    "price_night": (r"\b(?:\w+ )?(?:mot|1|qua|ca) dem\b|\b(?:tau nhanh|di khach|bao phe|phuc vu|tan giuong|massage|hang ngon|gai ngon)\b", "mot 1 qua ca tau di bao phuc tan massage hang gai|dem nhanh khach phe vu giuong massage ngon"),
    "contact": (r"\b(?:ib|inbox|nhan|zalo|link|share|gui|qua phong|qua nha|vao le)" + _MORE % 4 + r" (?:clip|nudes?|khong che|cmt|nong)\b|\bai (?:qua phong|ranh nghe|muon xem)\b", "ib inbox nhan zalo link share gui qua vao ai|clip nude nudes che cmt nong phong nghe xem"),
    "abuse_en": (rf"\b(?:{_ENGLISH})\b", _heads(_ENGLISH)),
}
_TEACHING = "giao duc|gioi tinh|suc khoe|bac si|benh vien|xet nghiem|kham|tiem ngua|vac xin|bai giang|tai lieu|nghien cuu|hoc sinh|tu van|sinh hoc|y te|thuoc|ung thu|dinh ky|phu khoa|tu cung|thai|sinh san"
_EVERYDAY = "con cho nha|cun|thit cho|cho meo|cho con|suc vat nuoi|quan tai go|do cho choi|ca chep|giong heo|heo quay|ga ta|nuoi heo|chan nuoi|nguc ga|mong tay|hang xom|dem trung thu|mot dem mua"
_QUOTED = "dung noi|khong nen noi|bi goi la|ban quyen|nghia cua tu|tu dien|phan anh|bai viet ve|nguoi ta hay goi|bao cao|to cao|len an|bi chui|bi mang"
_EMPHASIS = "vai|vl|vcl|dm|dmm|cmn|vai ca|vai chuong|me no|qua troi|dien dao|chet me|cuoi chet|chet cuoi|dep dien|ngon vl|dinh cua chop"
#: Voters for safe.
SAFE: dict[str, tuple[str, str | frozenset[str]]] = {
    "teaching": (rf"\b(?:{_TEACHING})\b", _heads(_TEACHING)),
    "everyday": (rf"\b(?:{_EVERYDAY})\b", _heads(_EVERYDAY)),
    "quoted": (rf"\b(?:{_QUOTED})\b", _heads(_QUOTED)),
    "emphasis": (rf"\b(?:{_EMPHASIS})\b", _heads(_EMPHASIS)),
}
#: Besides these a model learnt from the reviewed texts votes, and the reviewers themselves do.
VOTERS = [*UNSAFE, *SAFE, "like_unsafe", "like_safe", "review"]


def _compiled(voters: dict[str, tuple[str, str | frozenset[str]]]) -> list[tuple[re.Pattern[str], list[frozenset[str]]]]:
    return [(re.compile(p), [words] if isinstance(words, frozenset) else [frozenset(x.split()) for x in words.split("|")]) for p, words in voters.values()]


_UP, _DOWN = _compiled(UNSAFE), _compiled(SAFE)


def votes(plain_text: str, review: int | None, like: float = 0.5) -> list[int]:
    """1 unsafe, 0 safe, -1 abstains, in the order of VOTERS; like: what the model of the reviewed texts says."""
    words = plain_text.split()
    there = {*words, *map(" ".join, zip(words, words[1:], strict=False))}
    apart = there.isdisjoint
    up = [1 if not any(map(apart, w)) and p.search(plain_text) else -1 for p, w in _UP]
    down = [0 if not any(map(apart, w)) and p.search(plain_text) else -1 for p, w in _DOWN]
    return [*up, *down, 1 if like > 0.5 else -1, 0 if like < 0.02 else -1, -1 if review is None else review]


_WORDS = WordHash()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words and runs of two and three words of plain texts, hashed."""
    h, off = hash_batch(texts, _WORDS)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    run, docs, ats = np.zeros(len(h), np.uint64), [], []
    for k in range(3):
        run = (run[: max(0, len(h) - k)] ^ h[k:]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
        same = doc[: len(run)] == doc[k:]
        docs.append(doc[: len(run)][same])
        ats.append((run[same] % np.uint64(FEATURES)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(ats)


def sparse(texts: list[str]) -> Sparse:
    x = Sparse([], SCALE)
    x.row, x.at = features(texts)
    x.rows, x.scale = len(texts), np.full(len(texts), SCALE)
    return x


def rated(texts: list[str], w: np.ndarray, b: float) -> np.ndarray:
    doc, at = features(texts)
    return sigmoid(np.bincount(doc, w[at], len(texts)) * SCALE + b)


#: Where the label model starts and what it leans on: how often a voter speaks if it is right to, and if it is wrong to, as so many observations; the share of unsafe texts.
RIGHT, WRONG, LEAN, SHARE = 0.08, 0.008, 20.0, 0.05
#: How much more a reviewed text counts than another one for the voters' accuracies.
REVIEWED = 10.0


def label_model(vectors: np.ndarray, counts: np.ndarray, rounds: int = 60, reviews: bool = True) -> tuple[np.ndarray, list[int]]:
    """Posterior of unsafe for each vote vector (voters and the review, last), and each voter's parent (-1: none).

    vectors: (n, voters) of -1, 0, 1. Expectation-maximisation over tables P(vote
    | label, parent's vote), first without parents, then with those of ``_tree``.
    The tables lean on the voters' meaning, so labels can't turn, and on the
    reviewed texts, where there are any. A review tells of the label only by
    what it says, not by being there. ``reviews``: use the last column.
    """
    v = vectors + 1
    n, m = v.shape
    m -= 1
    said = v[:, -1] if reviews else np.zeros(n, int)
    mark = np.array([[0.0, 0.0], [np.log(0.04), np.log(0.98)], [np.log(0.96), np.log(0.02)]])  # P(mark | unsafe), P(mark | safe) by what is said
    weight = counts * np.where(said > 0, REVIEWED, 1.0)
    total = counts.sum()
    parent = [-1] * m

    def prior_of(j: int) -> np.ndarray:
        unsafe = VOTERS[j] in UNSAFE or VOTERS[j] == "like_unsafe"
        lean = np.zeros((2, 3))
        right, wrong = (RIGHT, WRONG) if unsafe else (3 * RIGHT, RIGHT)
        lean[1, 2 if unsafe else 1], lean[0, 2 if unsafe else 1] = (right, wrong) if unsafe else (wrong, right)
        lean[:, 0] = 1 - lean.sum(1)
        return LEAN * lean

    def tables(p: np.ndarray) -> list[np.ndarray]:
        w = np.stack([weight * (1 - p), weight * p])
        out = []
        for j in range(m):
            a = np.zeros((2, 3, 3))
            up = v[:, parent[j]] if parent[j] >= 0 else np.zeros(n, int)
            for y in (0, 1):
                np.add.at(a[y], (up, v[:, j]), w[y])
            flat = a.sum(1) + prior_of(j)
            flat /= flat.sum(1, keepdims=True)
            a += LEAN * flat[:, None, :] + 1e-3
            out.append(a / a.sum(2, keepdims=True))
        return out

    def posterior(share: float, t: list[np.ndarray]) -> np.ndarray:
        z = np.full(n, np.log(share / (1 - share))) + mark[said, 0] - mark[said, 1]
        for j in range(m):
            up = v[:, parent[j]] if parent[j] >= 0 else np.zeros(n, int)
            z += np.log(t[j][1, up, v[:, j]]) - np.log(t[j][0, up, v[:, j]])
        return sigmoid(z)

    first = np.stack([prior_of(j) for j in range(m)]) if m else np.zeros((0, 2, 3))
    start = [np.repeat((x / x.sum(1, keepdims=True))[:, None, :], 3, axis=1) for x in first]
    share, p = SHARE, posterior(SHARE, start)
    for turn in range(2):
        for _ in range(rounds):
            share = float((counts * p).sum() + SHARE * LEAN) / (total + LEAN)
            p = posterior(min(max(share, 1e-4), 0.9), tables(p))
        if turn == 0:
            parent = _tree(v[:, :m], counts, p)
    return p, [*parent, -1]


def _tree(v: np.ndarray, counts: np.ndarray, p: np.ndarray, least: float = 1e-3) -> list[int]:
    """Parents by the strongest mutual information of votes given the label (a forest)."""
    n, m = v.shape
    w = np.stack([counts * (1 - p), counts * p])
    edges = []
    for i in range(m):
        for j in range(i):
            info = 0.0
            for y in (0, 1):
                a = np.zeros((3, 3))
                np.add.at(a, (v[:, i], v[:, j]), w[y])
                a = a / max(counts.sum(), 1e-9)
                e = a.sum(1, keepdims=True) * a.sum(0, keepdims=True) / max(a.sum(), 1e-12)
                ok = a > 0
                info += float((a[ok] * np.log(a[ok] / e[ok])).sum())
            edges.append((info, i, j))
    parent, group = [-1] * m, list(range(m))
    near: dict[int, list[int]] = {i: [] for i in range(m)}
    for info, i, j in sorted(edges, reverse=True):
        if info >= least and group[i] != group[j]:
            old = group[i]
            group = [group[j] if g == old else g for g in group]
            near[i].append(j)
            near[j].append(i)
    seen: set[int] = set()
    for root in range(m):
        stack = [root] if root not in seen else []
        seen.add(root)
        while stack:
            k = stack.pop()
            for x in near[k]:
                if x not in seen:
                    seen.add(x)
                    parent[x] = k
                    stack.append(x)
    return parent


def marks(reviews: DataFrame) -> DataFrame:
    """(id, review): the reviewers' mark of a record, null marks left out; ties don't count."""
    r = reviews.where("id is not null and unsafe in (0, 1)").groupBy("id").agg(F.avg("unsafe").alias("m"))
    return r.where("m <> 0.5").select("id", (F.col("m") > 0.5).cast("int").alias("review"))


def marks_models(texts: list[str], y: list[int]) -> list[tuple[np.ndarray, float]]:
    """Two classifiers, each of one half of the reviewed texts (by ``_half``), for votes on the other half and on all others."""
    out = []
    for half in (0, 1):
        mine = [i for i, t in enumerate(texts) if _half(t) == half]
        if len({y[i] for i in mine}) < 2:
            out.append((np.zeros(FEATURES), 0.0))
            continue
        part, label = sparse([texts[i] for i in mine]), np.array([float(y[i]) for i in mine])
        out.append(fit_scaled(part, label, FEATURES, l2=0.5, steps=100, weight=np.ones(len(mine))))
    return out


def _half(plain_text: str) -> int:
    return xxhash.xxh3_64_intdigest(plain_text) >> 8 & 1


def likes(texts: list[str], reviewed: list[int | None], models: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """How like the unsafe reviewed texts each text is; a reviewed one by the model that hasn't seen its words."""
    a, b = (rated(texts, *m) for m in models)
    half = np.array([_half(t) if r is not None else -1 for t, r in zip(texts, reviewed, strict=True)])
    return np.where(half == 0, b, np.where(half == 1, a, (a + b) / 2))


class Supervision:
    """What one fit gives: the votes (written), the label model over all vote vectors, the classifier."""

    def __init__(self, voted: DataFrame, vectors: np.ndarray, counts: np.ndarray, posterior: np.ndarray, parent: list[int], model: tuple[np.ndarray, float]) -> None:
        self.voted, self.vectors, self.counts, self.posterior, self.parent, self.model = voted, vectors, counts, posterior, parent, model


def _share(n: int, most: int) -> float:
    return min(1.0, most / max(n, 1))


def _below(part: float) -> int:
    """The bound of a 64-bit hash that about this share of rows is below."""
    return min(2**63 - 1, int(-(2**63) + part * (2**64 - 1)))


def supervised(posts: DataFrame, reviews: DataFrame) -> Supervision:
    """Votes of ``posts``(id, text, source) and ``reviews``(id, unsafe), the label model and the classifier trained on its posteriors."""
    spark = posts.sparkSession
    given = stored(marks(reviews), "marks")
    src = posts.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    seen = src.where("text is not null").join(given.where(F.xxhash64("id") <= F.lit(_below(_share(given.count(), SAMPLE)))), "id").select("text", "review").collect()
    told = sorted((plain(r.text), r.review) for r in seen)
    models = spark.sparkContext.broadcast(marks_models([t for t, _ in told], [y for _, y in told]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                t, review = [plain(x) for x in b.column(1).to_pylist()], b.column(3).to_pylist()
                like = likes(t, review, models.value)
                v = [votes(x, r, y) for x, r, y in zip(t, review, like, strict=True)]
                told = [max(x[:-1]) == 1 or x[-1] >= 0 for x in v]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.string()), b.column(2), pa.array([bytes(y + 1 for y in x) for x in v], pa.binary()), pa.array(told, pa.bool_())], names=["id", "plain", "source", "v", "told"])

    all_ = spread(src).join(given, "id", "left")
    voted = stored(all_.select("id", "text", "source", "review").mapInArrow(vote, "id bigint, plain string, source string, v binary, told boolean"), "votes")
    per = voted.groupBy("v", "told").agg(F.count(F.lit(1)).alias("n")).toPandas()  # the kinds of vectors, not rows
    per = per.sort_values("v").reset_index(drop=True)
    vectors = np.array([list(bytes(x)) for x in per["v"]], np.int64).reshape(len(per), len(VOTERS)) - 1
    counts = per["n"].to_numpy(np.float64)
    p, parent = label_model(vectors, counts)
    of = {bytes(x): float(y) for x, y in zip(per["v"], p, strict=True)}

    part = {told: _share(int(per["n"][per["told"] == told].sum()), SAMPLE) for told in (True, False)}
    h = F.xxhash64("plain", "id")  # so samples of both kinds are the same in any partitioning
    chosen = voted.where(h <= F.when(F.col("told"), F.lit(_below(part[True]))).otherwise(F.lit(_below(part[False])))).select("plain", "v", "told").toPandas().sort_values(["plain", "v"])
    y = np.array([of[bytes(b)] for b in chosen["v"]])
    weight = np.array([1 / part[bool(t)] for t in chosen["told"]])
    model = fit_scaled(sparse(chosen["plain"].tolist()), y, FEATURES, l2=0.1, steps=120, weight=weight)
    return Supervision(voted, vectors, counts, p, parent, model)


def scores(posts: DataFrame, reviews: DataFrame) -> DataFrame:
    """(id, source, score) of ``posts``(id, text, source): score between 0 and 1; null and blank texts have 0.

    ``reviews``(id, unsafe) may be empty. Repeated rows keep their number.
    """
    s = supervised(posts, reviews)
    shared = posts.sparkSession.sparkContext.broadcast(s.model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                t = b.column(1).to_pylist()
                z = rated(t, *shared.value) * np.array([bool(i) for i in t])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(z, pa.float64())], names=["id", "source", "score"])

    return s.voted.select("id", "plain", "source").mapInArrow(rate, "id bigint, source string, score double")


def voters(s: Supervision) -> DataFrame:
    """One row per voter: (voter, says, n_votes, accuracy, coverage, parent, n_reviewed, reviewed_accuracy).

    accuracy: the share of its votes that the label model's posterior agrees
    with; reviewed_accuracy: the share that reviewers' marks agree with, among
    the marked records (null without any); parent: the voter its vote depends on.
    """
    rows, total = [], max(float(s.counts.sum()), 1.0)
    truth = s.vectors[:, -1] if len(s.vectors) else np.empty(0)
    for j, name in enumerate(VOTERS):
        n = right = seen = same = 0.0
        for side, p in ((1, s.posterior), (0, 1 - s.posterior)):
            on = s.vectors[:, j] == side
            n += float(s.counts[on].sum())
            right += float((s.counts * p)[on].sum())
            seen += float(s.counts[on & (truth >= 0)].sum())
            same += float(s.counts[on & (truth == side)].sum())
        says = "both" if name == "review" else "safe" if name in SAFE or name == "like_safe" else "unsafe"
        rows.append((name, says, int(n), round(right / n, 6) if n else None, n / total, VOTERS[s.parent[j]] if s.parent[j] >= 0 else None, int(seen), round(same / seen, 6) if seen else None))
    return s.voted.sparkSession.createDataFrame(rows, "voter string, says string, n_votes bigint, accuracy double, coverage double, parent string, n_reviewed bigint, reviewed_accuracy double")


def flagged(scored: DataFrame, least: float = 0.5) -> DataFrame:
    return scored.where(F.col("score") >= least).select("id")


def rates(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Per source, in one spelling (lower case, words joined by underscores): rows, flagged rows and their share."""
    name = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source")
    return scored.groupBy(name).agg(F.count(F.lit(1)).alias("n_posts"), F.count(F.when(F.col("score") >= least, 1)).alias("n_flagged"), F.round(F.avg((F.col("score") >= least).cast("double")), 6).alias("rate"))
