"""Text expressions, Column -> Column. White space is Python's, the same in Spark and in the SQL of the catalog."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the white space that Python's str.split knows, as a regex class for Java and RE2.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_.]"
#: What the scraped pages' own lines look like.
LEAD = rf"(?iu)^(?:(?:thịnh hành|thread đầu tiên){WS}*)+"
SPOILER = "tiết lộ nội dung"
REPLY = rf"(?iu)đang trả lời @{WORD}+{WS}*"
REPOST, TRANSLATE, JUST_NOW = "đã đăng lại", "dịch", "vừa xong"
AGO = rf"^\p{{Nd}}+{WS}+(giây|phút|giờ|ngày|tuần|tháng|năm)"
DATE = r"^\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}$"
COUNT = r"^[\p{Nd}.,kKmM]+$"
SLIDE = rf"^#\p{{Nd}}+:{WS}*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no expression for it."""
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def normalized(c: Column) -> Column:
    """What exact deduplication compares: composed, lower case, white space collapsed."""
    return collapse(F.lower(nfc(c)))


def mask_handles(c: Column) -> Column:
    return F.regexp_replace(c, f"@{WORD}+", "username")


def keep_reply_side(c: Column) -> Column:
    """What stands before 'replying to @user', or after it if nothing does."""
    parts = F.split(c, REPLY, 2)
    before, after = strip(parts[0]), strip(F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 2, F.when(before != "", before).otherwise(after)).otherwise(c)


def text_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def cut_translate(line: Column) -> Column:
    return F.when(F.lower(line).endswith(f" {TRANSLATE}"), strip(F.substring(line, 1, F.length(line) - 5))).otherwise(line)


def is_stamp(line: Column) -> Column:
    low = F.lower(line)
    return ~low.contains(REPOST) & (low.rlike(AGO) | line.rlike(DATE) | low.contains(JUST_NOW))


def distinct_neighbours(lines: Column) -> Column:
    """Without lines equal to the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def drop_repeated_tail(lines: Column) -> Column:
    """Without the longest block at the end that only repeats the block before it; done once."""
    n = F.size(lines)
    half = F.floor(n / 2).cast("int")
    same = F.filter(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda k: (2 * k <= n) & (F.get(lines, n - 1) == F.get(lines, n - 1 - k)) & (F.slice(lines, n - k + 1, k) == F.slice(lines, F.greatest(n - 2 * k + 1, F.lit(1)), k)))
    return F.when(n < 2, lines).otherwise(F.slice(lines, F.lit(1), n - F.coalesce(F.array_max(same), F.lit(0))))


def halve_repeated(c: Column, least: int = 0) -> Column:
    """One half of a text whose halves are equal, for texts of more than ``least`` characters."""
    half = F.floor(F.length(c) / 2).cast("int")
    left = strip(F.substring(c, F.lit(1), half))
    right = strip(F.substring(c, half + 1, F.length(c)))
    return F.when((F.length(c) > least) & (F.length(c) > 0) & (left == right), left).otherwise(c)


def clean_caption(c: Column) -> Column:
    """A group post's caption: halved if doubled, without spaced letters, domains and long codes, collapsed."""
    # The three patterns, single letters set apart, domains, long codes.
    c = halve_repeated(c, 20)
    c = F.regexp_replace(c, r"(?:\b[a-zA-Z0-9]\s){2,}[a-zA-Z0-9]\b", "")
    c = F.regexp_replace(c, r"\S+\.[a-z]{2,4}\b", "")
    c = F.regexp_replace(c, r"\b[a-zA-Z0-9]{15,}\b", "")
    return collapse(c)


def clean_facebook(c: Column) -> Column:
    """A scraped page post: without a repeated block of lines at its end, halved if doubled; null if nothing is left."""
    tailless = lambda t: _once(F.split(t, "\n"), drop_repeated_tail)
    halved = lambda t: _once(strip(F.array_join(tailless(t), "\n")), halve_repeated)
    return _once(strip(c), lambda t: F.when(t != "", _once(halved(t), lambda x: F.when(x != "", x))))


def word_grams(c: Column, k: int = 3) -> Column:
    """The distinct runs of k words of a text whose words are parted by single blanks; a shorter text is one run."""
    w = F.split(c, " ")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    return F.when((F.size(w) < k) | (c == ""), F.array(c)).otherwise(F.array_distinct(runs))


def image_id(url: Column) -> Column:
    """The long number in a CDN address, else the address."""
    found = F.regexp_extract(url, r"/([0-9]{9,})[_.]", 1)
    return F.when(found != "", found).otherwise(url)


def joined_parts(parts: Column, least: int = 3) -> Column:
    """Distinct parts of at least ``least`` characters, in order, joined by blanks."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least)), " ")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def post_image_name(number: Column, path: Column, index: Column | None = None) -> Column:
    """post00012.jpg, or post00012_img01.jpg for the first of several images."""
    if index is None:
        return F.format_string("post%05d%s", number, suffix(path))
    return F.format_string("post%05d_img%02d%s", number, index, suffix(path))


def clean_threads(df: DataFrame, text: str = "text", out: str = "clean") -> DataFrame:
    """``df`` and the column ``out``: the post without the page's own lines; null if nothing is left.

    The steps go in order, each a column of its own so that lambdas read a
    value and not an expression. Null and blank texts give null.
    """
    t = strip(F.regexp_replace(strip(F.col(f"`{text}`")), LEAD, ""))
    d = df.withColumn("__t", t)
    d = d.withColumn("__t", F.when(~F.lower("__t").contains(SPOILER), mask_handles(keep_reply_side(F.col("__t")))))
    d = d.withColumn("__l", F.transform(text_lines(F.col("__t")), cut_translate))
    marked = F.transform(
        "__l",
        lambda x: F.struct(
            x.alias("t"), F.lower(x).contains(REPOST).alias("repost"), is_stamp(x).alias("stamp"), ((F.lower(x) == TRANSLATE) | x.rlike(COUNT) | (x == "/")).alias("drop"), (F.size(F.filter(F.split(x, f"{WS}+"), lambda w: w != "")) <= 5).alias("short")
        ),
    )
    d = d.withColumn("__m", marked)
    m = F.col("__m")
    at = lambda i, f: F.coalesce(F.get(m, i)[f], F.lit(False))
    kept = F.filter(m, lambda x, i: ~(x["repost"] | at(i - 1, "repost") | x["drop"] | x["stamp"] | at(i + 1, "stamp") | (at(i + 2, "stamp") & x["short"])))
    d = d.withColumn("__k", F.transform(kept, lambda x: x["t"]))
    d = d.withColumn("__k", F.filter("__k", lambda x, i: ~(x.rlike(SLIDE) & (i < F.size("__k") - 1))))
    d = d.withColumn("__k", distinct_neighbours(F.col("__k")))
    d = d.withColumn(out, blank_to_null(strip(F.array_join(drop_repeated_tail(F.col("__k")), "\n"))))
    return d.drop("__t", "__l", "__m", "__k")
