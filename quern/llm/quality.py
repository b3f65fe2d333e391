"""Text quality statistics and rules that tell prose from lists, tables and junk (problem 9).

Statistics of characters and lines are Catalyst expressions; those of words and
of repetition are made of the array of tokens in one vectorised pass.
A document is judged in the stage that scans it, without a shuffle. Null texts give null statistics and are not prose; blank texts have
0 words and are neither prose nor a case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import stored

# Frequent function words of Vietnamese (with and without accents) and English.
COMMON_WORDS = (
    "là và của có cho không người một đã với những các được trong này thì mà ở để từ cũng khi đến rồi ra vẫn nhưng như lại "
    "mình tới vào còn chỉ sau nào nghe bảo cả nên lắm luôn vừa mới đang sẽ nếu vì do bởi trước bên mấy ai gì đi hơn xong "
    "la va cua co khong nguoi mot da voi nhung cac duoc trong nay thi ma de tu cung khi den roi van nhu lai minh toi vao con chi sau "
    "the a an and of to in it is was for on with that this my i we you but from because as at by be are not or so if they"
).split()

_ITEM = r"^\s*(?:[-*•+–—▪●○►→✓✔✅☑➤👉🔸🔹🌱📌⭐]|\(?\d{1,3}[.)]|[a-zA-Z][.)])\s*"
_END = r"[.!?…:;,)\]\"'”]\s*$|[:=]\)+\s*$|\p{So}\s*$"
#: Letters that only stand together where UTF-8 was read as another encoding.
_BROKEN = r"[ÃÂÄÅ][\x{0080}-\x{00BF}\x{2018}-\x{2122}]|áº|á»|Æ°|Ä‘|ðŸ|\x{FFFD}"
#: Page controls and counts that scraped comment pages are full of.
_CONTROLS = (
    r"(?iu)(?<![\p{L}\p{N}])(?:xem thêm bình luận|xem thêm|xem bản dịch|phù hợp nhất|đã chỉnh sửa|trả lời|chia sẻ|thích|theo dõi|bình luận|tác giả|gif|dịch|"
    r"view more comments|see more|see translation|most relevant|edited|reply|share|like|follow|comment|"
    r"\d+\s*(?:giây|phút|giờ|ngày|tuần|tháng|năm|h|d|w)|\d+(?:[.,]\d+)?[km]?|\d+/\d+)(?![\p{L}\p{N}])"
)
_CELL = r"\t|\s\|\s|^\s*\||\|\s*$|;|\s/\s|\s/$|^/\s|\s{3,}"


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text statistics). Shares are between 0 and 1, and 0 where there is nothing to share.

    Words are blank-free runs with a letter or digit, lines the non-blank ones.
    top_word: the share of the most frequent word; top coverage: the share of
    characters that the most frequent run of 2, 3 or 4 words covers, if it occurs
    twice; repeated_bigrams: the share of characters in word pairs that occur more
    than once; repeated_runs: the share of runs of 5 words equal to an earlier
    one; stretch_words: distinct_words counted anew every 400 words, so that it
    doesn't fall with length; duplicate lines and paragraphs: the share of lines
    (paragraphs) equal to an earlier one.
    """
    c = F.col
    t = F.regexp_replace(c("__t"), r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}\x{FE0F}]", "")
    one = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__t")).withColumn("__t", F.regexp_replace(t, r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]", " "))
    lines = F.filter(F.split("__t", r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    paragraphs = F.filter(F.split("__t", r"(?:\r?\n\s*){2,}"), lambda x: x.rlike(r"\S"))
    tokens = F.filter(F.split("__t", r"\s+"), lambda x: x != "")
    two = one.withColumns({"__lines": lines, "__paras": paragraphs, "__tokens": tokens})
    nl, nt = F.size("__lines"), F.size("__tokens")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    count = lambda arr, f: F.size(F.filter(arr, f))
    chars = F.length(F.regexp_replace("__t", r"\s+", ""))
    letters = F.length(F.regexp_replace("__t", r"[^\p{L}\p{M}]+", ""))
    digits = F.length(F.regexp_replace("__t", r"[^\p{N}]+", ""))
    pictures = F.length(F.regexp_replace("__t", r"[^\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{200D}]+", ""))
    left = F.length(F.regexp_replace(F.regexp_replace("__t", _CONTROLS, ""), r"[^\p{L}\p{N}]+", ""))
    made = two.select(
        c(key),
        F.when(c("__t").isNotNull(), F.length("__t")).cast("bigint").alias("n_chars"),
        nl.cast("bigint").alias("n_lines"),
        chars.alias("__chars"),
        share(chars - letters - digits, chars).alias("symbol_ratio"),
        share(letters, chars).alias("letter_ratio"),
        share(digits, chars).alias("digit_ratio"),
        share(pictures, chars).alias("picture_ratio"),
        share(count("__lines", lambda x: x.rlike(_END)), nl).alias("ended_lines"),
        share(count("__lines", lambda x: x.rlike(_ITEM)), nl).alias("item_lines"),
        share(count("__lines", lambda x: x.rlike(_CELL) & (F.size(F.split(x, r"\t|\s*\|\s*|;|\s/\s|\s{3,}")) > 2)), nl).alias("cell_lines"),
        share(count("__lines", lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 7), nl).alias("short_lines"),
        (1 - share(left, F.length(F.regexp_replace("__t", r"[^\p{L}\p{N}]+", "")))).alias("control_ratio"),
        share(F.length("__t") - F.length(F.regexp_replace("__t", _BROKEN, "")), chars).alias("broken_ratio"),
        share(nl - F.size(F.array_distinct("__lines")), nl).alias("duplicate_lines"),
        share(F.size("__paras") - F.size(F.array_distinct("__paras")), F.size("__paras")).alias("duplicate_paragraphs"),
        F.when(nt >= 0, c("__tokens")).otherwise(F.array().cast("array<string>")).alias("__tokens"),
    )
    made = _with_words(made)
    n, nl = c("n_words"), c("n_lines")
    return made.withColumns({"words_per_line": share(n, nl), "control_ratio": F.when(n > 0, c("control_ratio")).otherwise(F.lit(0.0))}).select(key, *STATISTICS)


#: The columns of ``statistics``.
STATISTICS = [
    "n_chars", "n_words", "n_lines", "mean_word_length", "words_per_line", "symbol_ratio", "letter_ratio", "digit_ratio", "picture_ratio", "ended_lines", "item_lines", "cell_lines", "short_lines", "common_words", "tag_ratio", "link_ratio", "alpha_words", "single_letters", "odd_tokens", "control_ratio", "coded_ratio", "broken_ratio", "duplicate_lines", "duplicate_paragraphs",
    "distinct_words", "top_word", "top_bigram_coverage", "top_trigram_coverage", "top_fourgram_coverage", "repeated_bigrams", "repeated_runs", "stretch_words",
]
#: Statistics that are made of a document's words and tokens (runs without blanks).
WORDS = ["mean_word_length", "common_words", "tag_ratio", "link_ratio", "alpha_words", "single_letters", "odd_tokens", "coded_ratio"]

#: Statistics of repetition, made of a document's words.
REPETITION = ["distinct_words", "top_word", "top_bigram_coverage", "top_trigram_coverage", "top_fourgram_coverage", "repeated_bigrams", "repeated_runs", "stretch_words"]
STRETCH = 400


class _Tokens(dict):
    """What a token is by itself: the word in it, whether it is a tag, a link, odd, how much of it is code."""

    def __init__(self) -> None:
        import regex

        blank = r"[^ \t\n\x0b\f\r]"
        self.trim = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
        self.letter = regex.compile(r"\p{L}")
        self.link = regex.compile(rf"(?:https?:|www\.)|{blank}*?\.(?:com|vn|net|example|test)\b")
        self.odd = regex.compile(r"[;|~`¦_^<>=\\{}].*|.*?[\p{L}\p{N}][;|~`'¦_^<>=\\{}\[\]$%*#]+[\p{L}\p{N}].*|.*[;|~`¦_^<>=\\{}]", regex.DOTALL)
        self.code = regex.compile(r"(?!https?:|www\.|@)(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{16,}", regex.DOTALL)
        self.common = frozenset(COMMON_WORDS)

    def __missing__(self, token: str) -> tuple:
        if len(self) >= 500_000:
            self.clear()
        word, letter = self.trim.sub("", token).lower(), bool(self.letter.search(token))
        alpha = bool(word) and bool(self.letter.search(word))
        out = self[token] = (
            word, len(word), word in self.common, alpha, alpha and len(word) <= 1, len(token) > 1 and token[0] in "#@", bool(self.link.match(token)), letter and bool(self.odd.fullmatch(token)), len(token) if self.code.fullmatch(token) else 0,
        )
        return out


_known: _Tokens | None = None


def _with_words(df: DataFrame) -> DataFrame:
    """``df``(..., __chars, ..., __tokens array<string>) with n_words, ``WORDS`` and ``REPETITION`` instead of chars and tokens, for all documents of a batch at once.

    A token is looked at once a batch however often it occurs, and remembered.
    """
    names = [x for x in df.columns[:-1] if x != "__chars"]
    at_chars, made = df.columns.index("__chars"), ["n_words", *WORDS, *REPETITION]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _known
        _known = known = _known or _Tokens()
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                lists = part.column(part.num_columns - 1)
                of = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                facts = [known[x] for x in coded.dictionary.to_pylist()]
                doc = np.repeat(np.arange(part.num_rows), of)
                chars = part.column(at_chars).fill_null(0).to_numpy(zero_copy_only=False)
                out = token_statistics(of, doc, at, facts, chars)
                keep = [i for i in range(part.num_columns - 1) if i != at_chars]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *[pa.array(out[x]) for x in made]], names=[*names, *made])

    fields = [f for f in df.schema.fields[:-1] if f.name != "__chars"]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in made[1:]]])
    return df.mapInArrow(run, schema)


def token_statistics(of: np.ndarray, doc: np.ndarray, at: np.ndarray, facts: list[tuple], chars: np.ndarray) -> dict[str, np.ndarray]:
    """``WORDS`` and ``REPETITION`` of documents of ``of`` tokens each; ``at`` says for each token which of ``facts`` it has."""
    docs = len(of)
    number: dict[str, int] = {}
    word = np.array([number.setdefault(f[0], len(number)) for f in facts], np.int64) if facts else np.empty(0, np.int64)
    size, common, alpha, single, tag, link, odd, code = (np.array([f[i] for f in facts], np.int64)[at] if facts else np.empty(0, np.int64) for i in range(1, 9))
    is_word = size > 0
    total = lambda x: np.bincount(doc, x, docs)
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    n = np.bincount(doc[is_word], minlength=docs)
    letters = total(alpha)
    out = {
        "n_words": n, "mean_word_length": share(total(size), n), "common_words": share(total(common), n), "tag_ratio": share(total(tag), of), "link_ratio": share(total(link), of), "alpha_words": share(letters, n), "single_letters": share(total(single), letters), "odd_tokens": share(total(odd), of), "coded_ratio": share(total(code), chars),
    }
    return out | repetition(n, (word[at] if facts else at)[is_word], size[is_word])


def repetition(n: np.ndarray, word: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of documents of ``n`` words each, given all their words in order as numbers (equal words, equal numbers) and lengths."""
    docs = len(n)
    doc = np.repeat(np.arange(docs), n)
    first = np.cumsum(n) - n
    place = np.arange(len(doc)) - first[doc]

    def share(a: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(of > 0, a / np.maximum(of, 1), 0.0)

    def counts(d: np.ndarray, key: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each different key of a document: the document, how often it occurs, its length."""
        o = np.lexsort((key, d))
        d, key = d[o], key[o]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        return d[at], np.diff(np.append(at, len(d))), chars[o][at]

    total = np.bincount(doc, size + 1, docs)  # characters of all words, each with a blank
    d, times, _ = counts(doc, word, size)
    most = np.zeros(docs)
    np.maximum.at(most, d, times)
    out = {"distinct_words": share(np.bincount(d, minlength=docs), n), "top_word": share(most, n)}
    code = word.astype(np.uint64) + np.uint64(1)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # each word a number of 64 even bits
        code = (code ^ (code >> np.uint64(31))) * np.uint64(by)
    gram, chars = code, size.copy()
    for k, name in ((2, "top_bigram_coverage"), (3, "top_trigram_coverage"), (4, "top_fourgram_coverage"), (5, "")):
        m = max(0, len(word) - k + 1)
        gram = gram[:m] * np.uint64(0x9E3779B97F4A7C15) + code[k - 1 :]
        gram ^= gram >> np.uint64(29)
        chars = chars[:m] + size[k - 1 :] + 1
        inside = place[:m] + k <= n[doc[:m]]
        d, times, long = counts(doc[:m][inside], gram[inside], chars[inside])
        again = times > 1
        if name:
            most = np.zeros(docs)
            np.maximum.at(most, d[again], (times * long)[again])
            out[name] = np.minimum(1.0, share(most, total))
        if k == 2:
            ends = np.zeros(docs)
            some = n > 1
            ends[some] = size[first[some]] + size[first[some] + n[some] - 1]
            out["repeated_bigrams"] = np.where(some, share(np.bincount(d[again], (times * long)[again], docs), total * 2 - ends - n - 1), 0.0)
        if k == 5:
            windows = np.maximum(n - k + 1, 0)
            out["repeated_runs"] = share(windows - np.bincount(d, minlength=docs), windows)
    piece = np.cumsum(-(-n // STRETCH)) - -(-n // STRETCH)
    d, _, _ = counts(piece[doc] + place // STRETCH, word, size)
    owner = np.repeat(np.arange(docs), -(-n // STRETCH))
    out["stretch_words"] = share(np.bincount(owner[d], minlength=docs), n)
    return out


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``statistics`` and the columns kind ('prose', 'list', 'table', 'junk', 'blank', null for null text) and is_prose.

    Rules are combined in the order table, list, grid of numbers, junk; a rule needs most of the
    document's lines or words, so sloppy prose and prose with a short list or
    some tags stay prose.
    """
    s = statistics(df, key, text)
    c = F.col
    junk = (
        (c("n_words") == 0)
        | (c("letter_ratio") < 0.35) & (c("cell_lines") < 0.5) & (c("item_lines") < 0.5)
        | (c("picture_ratio") > 0.5)
        | (c("tag_ratio") + c("link_ratio") > 0.5)
        | (c("broken_ratio") > 0.05)
        | (c("odd_tokens") > 0.15)
        | (c("coded_ratio") > 0.5)
        | (c("n_words") >= 8) & (c("control_ratio") > 0.7)
        | (c("n_words") >= 8) & ((c("single_letters") > 0.3) | (c("top_word") > 0.35) | (c("stretch_words") < 0.2))
        | (F.greatest("top_bigram_coverage", "top_trigram_coverage", "top_fourgram_coverage") > 0.3)
        | (c("repeated_runs") > 0.5)
        | (c("duplicate_lines") > 0.5)
        | (c("duplicate_paragraphs") > 0.5)
        | (c("n_words") >= 8) & (c("common_words") < 0.02) & (c("mean_word_length") > 7)
    )
    table = (c("n_lines") >= 2) & (c("cell_lines") > 0.6)
    grid = (c("n_lines") >= 3) & (c("short_lines") > 0.6) & (c("digit_ratio") > 0.15)
    items = (c("n_lines") >= 3) & (c("words_per_line") < 9) & ((c("item_lines") > 0.6) | (c("short_lines") > 0.7) & (c("ended_lines") < 0.5) & ((c("common_words") < 0.12) | (c("short_lines") > 0.85) & (c("ended_lines") < 0.3) & (c("words_per_line") < 5)))
    kind = F.when(c("n_chars").isNull(), None).when(c("__blank"), "blank").when(table, "table").when(items, "list").when(grid, "table").when(junk, "junk").otherwise("prose")
    blank = (c("n_chars") == 0) | ((c("n_words") == 0) & (c("symbol_ratio") == 0) & (c("letter_ratio") == 0))
    return s.withColumn("__blank", blank).withColumn("kind", kind).withColumn("is_prose", F.coalesce(c("kind") == "prose", F.lit(False))).drop("__blank")


def not_prose(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of documents with a non-blank text that isn't prose."""
    # written before the filter: pushed down, it would hold a copy of every statistic and evaluate each again
    return stored(judged(df, key, text).select(key, "kind"), "kinds").where("kind in ('junk', 'table', 'list')").select(key)
