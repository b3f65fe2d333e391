"""One consistent form for texts that look alike (problem 3).

The form keeps what a reader sees and drops the rest:

* full-width, half-width and styled letters become plain ones;
* every kind of space becomes U+0020, every line end ``\\n``; blanks at both
  ends of the text go;
* invisible characters (format and control characters, fillers, variation
  selectors) go; a zero-width joiner stays only between two pictographs, where
  it changes the picture;
* letters of other scripts that look like Latin ones become these, the hyphens
  that look like the common one become this;
* combining marks are put in canonical order and composed.

Letter case, visible accents and visible signs stay. The form of a form is
itself. ``canonical`` does it for a Python string, ``with_canonical`` for a
DataFrame; both read the same tables and give the same result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.session import spread, stored

# Look-alike letters, each string above its Latin counterpart.
LOOK_ALIKES = [
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("οναρυϲϳ", "ovapucj"),  # Greek small letters
    ("АВЕЅІЈКМНОРСТУХԌԚԜҺӀ", "ABESIJKMHOPCTYXGQWHI"),  # Cyrillic capitals
    ("асеорхуѕіјһԁԛԝѵӏ", "aceopxysijhdqwvl"),  # Cyrillic small letters
    ("օսոհցՕՍ", "ounhgOU"),  # Armenian
    ("ɑɡⅼⅽⅾⅿⅰⅴⅹⅠⅤⅩⅬⅭⅮⅯ", "aglcdmivxIVXLCDM"),  # Latin variants, Roman numerals
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZRWVSLCPKB"),  # Cherokee
    ("ⲞⲟⲢⲣⲤⲥⲘⲚⲎⲔⲦⲬⲂⲒ", "OoPpCcMNHKTXBI"),  # Coptic
    ("ÐƉ", "ĐĐ"),  # eth and African d, drawn as D with stroke
]

_EMOJI = "\xa9\xae\u2190-\u21ff\u2300-\u27bf\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
_FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
_SELECTORS = "\ufe00-\ufe0f\U000e0100-\U000e01ef"
_ZWJ = "\u200d"
#: Done on whole texts first, as it depends on the neighbours.
_BEFORE = [
    (f"[{_SELECTORS}]", ""),
    ("\r\n?", "\n"),
    (f"{_ZWJ}{{2,}}", ""),
    (f"(^|[^{_EMOJI}]){_ZWJ}", r"\1"),
    (f"{_ZWJ}(?![{_EMOJI}])", ""),
]
_BLANK_ENDS = " \n"


def _simple(ch: str, cat: str) -> str | None:
    """The replacement of ``ch`` by the rules other than canonical ones."""
    if ch in ("\n", _ZWJ):
        return None
    if cat == "Zs" or ch in "\t\v\f":
        return " "
    if ch in "\r\x85\u2028\u2029":
        return "\n"
    if cat in ("Cf", "Cc") or ch in _FILLERS:
        return ""
    if ch in "\u2010\u2011":
        return "-"
    if ud.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>")):
        return ud.normalize("NFKC", ch)
    return None


@lru_cache(maxsize=1)
def translation() -> dict[int, str]:
    """Replacements of decomposed text, by code point."""
    table: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        cat = ud.category(ch := chr(cp))
        if cat not in ("Cs", "Cn", "Co") and (to := _simple(ch, cat)) is not None:
            table[cp] = to
    for odd, plain in LOOK_ALIKES:
        table |= {ord(a): b for a, b in zip(odd, plain, strict=True)}
    alike = {cp: to for cp, to in table.items() if len(to) == 1}
    table = {cp: ud.normalize("NFD", to).translate(alike) for cp, to in table.items()}
    return {cp: to for cp, to in table.items() if chr(cp) != to}


_SUSPECT = re.compile(r"[^\n -~]")
_PYTHON_BEFORE = [(re.compile(p), to) for p, to in _BEFORE]
#: Without one of these none of the above finds anything.
_NEEDS_BEFORE = re.compile(f"[{_SELECTORS}\r{_ZWJ}]")


def odd_characters() -> str:
    """The pattern of a character that isn't inert; the joiner is looked at on its own."""
    return "[^" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), inert_class()[: -len("\\x{200D}")]) + "]"


@lru_cache(maxsize=1)
def _odd() -> re.Pattern[str]:
    return re.compile(odd_characters())


def canonical(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null, a blank text becomes empty."""
    if text is None:
        return None
    if _SUSPECT.search(text) and _odd().search(text):
        text = _full(text)
    return text.strip(_BLANK_ENDS)


@lru_cache(maxsize=1)
def _by_character() -> dict[str, str]:
    """``translation`` by character. No replacement holds a character that is replaced, so their order doesn't matter."""
    return {chr(cp): to for cp, to in translation().items()}


def _full(text: str) -> str:
    if _NEEDS_BEFORE.search(text):
        for pattern, to in _PYTHON_BEFORE:
            text = pattern.sub(to, text)
    text, table = ud.normalize("NFD", text), _by_character()
    for ch in set(text):  # few of a text's characters are replaced
        if ch in table:
            text = text.replace(ch, table[ch])
    return ud.normalize("NFC", text)


@lru_cache(maxsize=1)
def _composites() -> dict[str, str]:
    """Primary composites by (first, second)."""
    pairs = {}
    for cp in range(sys.maxunicode + 1):
        d = ud.decomposition(ch := chr(cp))
        if d and d[0] != "<" and " " in d and ud.normalize("NFC", ch) == ch:
            pairs["".join(chr(int(x, 16)) for x in d.split())] = ch
    return pairs


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters of class 0 that compose with the one before (Hangul jamo included)."""
    seconds = {p[1] for p in _composites()}
    jamo = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    return frozenset({c for c in seconds if not ud.combining(c)} | jamo)


def _parts(ch: str) -> list[tuple[str, int, bool]]:
    full = ud.normalize("NFD", ud.normalize("NFD", ch).translate(translation()))
    return [(c, ud.combining(c), ud.combining(c) == 0 and c not in _joining()) for c in full]


@lru_cache(maxsize=1)
def tables() -> tuple[list, list]:
    """Rows (ch, parts) of all characters that aren't a plain starter, rows (nfd, composed)."""
    known, composed = [], []
    for cp in range(sys.maxunicode + 1):
        if ud.category(ch := chr(cp)) in ("Cs", "Cn", "Co"):
            continue
        if 0xAC00 <= cp <= 0xD7A3:  # syllables stay whole; from single jamo they are composed
            nfd = ud.normalize("NFD", ch)
            composed += [(nfd, ch)] + [(ud.normalize("NFC", nfd[:2]) + nfd[2:], ch)] * (len(nfd) == 3)
            continue
        parts = _parts(ch)
        if parts != [(ch, 0, True)]:
            known.append((ch, parts))
            nfd = ud.normalize("NFD", ch)
            if len(nfd) > 1 and (nfc := ud.normalize("NFC", nfd)) and len(nfc) == 1:
                composed.append((nfd, nfc))
    return known, sorted(set(composed))


@lru_cache(maxsize=1)
def inert_class() -> str:
    """A regex class of characters that the form leaves alone wherever they stand.

    A shortcut only: text of these alone is its own form, so it isn't exploded.
    """
    odd = {ch for ch, _ in tables()[0] if len(ud.normalize("NFC", ch)) != 1 or ch != _full("x" + ch + "x")[1:-1]}
    spans = [(0x0A, 0x0A), (0x20, 0x24F), (0x1E00, 0x1EF9), (0x2010, 0x20CF), (0x2190, 0x2BFF), (0x3001, 0x33FF), (0x4E00, 0x9FFF), (0x1F000, 0x1FAFF)]
    joined = _joining()
    out, start, last = [], None, None
    for a, b in [*spans, (0x110000, 0x10FFFF)]:
        for cp in [*range(a, b + 1), None]:
            ok = cp is not None and (c := chr(cp)) not in odd and not ud.combining(c) and c not in joined and ud.category(c) not in ("Cn", "Co", "Cs")
            if ok:
                start = cp if start is None else start
                last = cp
            elif start is not None:
                out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
                start = None
    return "".join(out) + "\\x{200D}"


def _java(pattern: str) -> str:
    return "".join(c if ord(c) < 128 else f"\\x{{{ord(c):X}}}" for c in pattern)


def _lookup(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    known, composed = tables()
    a = spark.createDataFrame(known, "__q_ch string, __q_parts array<struct<ch:string,ccc:int,starts:boolean>>")
    return a, spark.createDataFrame(composed, "__q_nfd string, __q_nfc string")


def _compose(marks: Column) -> Column:
    """Canonical composition of one cluster's sorted code points, for clusters in no table."""
    pairs = {p: c for p, c in _composites().items() if not 0xAC00 <= ord(c) <= 0xD7A3}
    table = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")
    start = F.struct(marks[0]["ch"].alias("base"), F.lit("").alias("tail"), F.lit(-1).alias("ccc"))

    def step(s: Column, m: Column) -> Column:
        made = F.try_element_at(table, F.concat(s["base"], m["ch"]))
        free = (s["tail"] == "") | (s["ccc"] < m["ccc"])
        return F.when(free & made.isNotNull(), F.struct(made.alias("base"), s["tail"].alias("tail"), s["ccc"].alias("ccc"))).otherwise(
            F.struct(s["base"].alias("base"), F.concat(s["tail"], m["ch"]).alias("tail"), F.when(m["ccc"] == 0, 999).otherwise(m["ccc"]).alias("ccc"))
        )

    return F.aggregate(F.slice(marks, 2, F.size(marks) - 1), start, step, lambda s: F.concat(s["base"], s["tail"]))


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` and the column ``out``: the consistent form of the column ``text``.

    Texts of inert characters pass in the scan's own stage. The others are cut
    into runs; runs with other characters are exploded to positioned code
    points, which a broadcast join decomposes and folds (both tables are
    bounded by the Unicode repertoire); marks are ordered by combining class,
    clusters recomposed by a second broadcast join, and strings rebuilt. All
    of that takes one shuffle, by row. Null gives null, blank gives ''; rows
    keep all their columns and their number; a column already called ``out``
    is replaced. Conjoining jamo followed by marks of other scripts are left as
    they stand.
    """
    known, composed = (F.broadcast(x) for x in _lookup(df.sparkSession))
    inert, order = inert_class(), W.partitionBy("__q_rid").orderBy("__q_n", "__q_k", "__q_j")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    text_col = F.col(f"`{text}`").cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(1).alias("__q_one")).alias("__q_row"), text_col.alias("__q_t"))
    dirty = F.coalesce(F.col("__q_t").rlike(f"[^{inert}]"), F.lit(False))
    done = lambda c: F.regexp_replace(c, "^[ \\n]+|[ \\n]+$", "")
    fields = lambda: [F.col(f"__q_row.`{c}`").alias(c) for c in kept]
    t = F.col("__q_t")
    for pattern, to in _BEFORE:
        t = F.regexp_replace(t, _java(pattern), to.replace("\\", "$"))
    plain = rows.where(~dirty).select(*fields(), done(t).alias(out))
    runs = F.regexp_extract_all(t, F.lit(f"([{inert}]+(?![^{inert}])|[{inert}]?[^{inert}]+)"), F.lit(1))
    runs = F.when(F.size(runs) > 0, runs).otherwise(F.array(F.lit("")))
    points = (
        rows.where(dirty)
        .select(F.monotonically_increasing_id().alias("__q_rid"), "__q_row", runs.alias("__q_runs"))
        .select("__q_rid", "__q_row", F.posexplode("__q_runs").alias("__q_n", "__q_run"))
        .select("__q_rid", "__q_n", F.when(F.col("__q_n") == 0, F.col("__q_row")).alias("__q_row"), F.posexplode(F.when(F.col("__q_run").rlike(f"[^{inert}]"), F.split("__q_run", "")).otherwise(F.array("__q_run"))).alias("__q_k", "__q_ch"))
        .withColumn("__q_row", F.when(F.col("__q_k") == 0, F.col("__q_row")))
        .join(known, "__q_ch", "left")
        .withColumn("__q_parts", F.coalesce("__q_parts", F.array(F.struct(F.col("__q_ch").alias("ch"), F.lit(0).alias("ccc"), F.lit(True).alias("starts")))))
        .select("__q_rid", "__q_n", "__q_k", "__q_row", F.posexplode_outer("__q_parts").alias("__q_j", "__q_p"))
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(order)
    clusters = (
        points.repartition("__q_rid")
        .withColumn("__q_c", count(F.col("__q_p.starts")))
        .withColumn("__q_s", count(F.col("__q_p.ccc") == 0))
        .groupBy("__q_rid", "__q_c")
        .agg(
            F.first("__q_row", ignorenulls=True).alias("__q_row"),
            F.array_sort(F.collect_list(F.when(F.col("__q_p").isNotNull(), F.struct(F.col("__q_s").alias("s"), F.col("__q_p.ccc").alias("ccc"), F.col("__q_n").alias("n"), F.col("__q_k").alias("k"), F.col("__q_j").alias("j"), F.col("__q_p.ch").alias("ch"))))).alias("__q_m"),
        )
        .withColumn("__q_nfd", F.array_join(F.transform("__q_m", lambda m: m["ch"]), ""))
        .join(composed, "__q_nfd", "left")
    )
    fixed = F.coalesce("__q_nfc", F.when(F.size("__q_m") > 1, _compose(F.col("__q_m"))).otherwise(F.col("__q_nfd")))
    built = clusters.groupBy("__q_rid").agg(
        F.first("__q_row", ignorenulls=True).alias("__q_row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__q_c").alias("c"), fixed.alias("t")))), lambda x: x["t"]), "").alias("__q_t"),
    )
    return plain.unionAll(built.select(*fields(), done(F.col("__q_t")).alias(out)))


def look_alike_pairs(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """All pairs (id_a < id_b) of rows with one form but different characters.

    Blank texts and rows without a key take no part. Variants are joined first
    (one row for each text and form), then expanded, a text of many copies in
    blocks, so one that holds a third of all rows costs what its pairs with other
    variants cost, in many tasks: equal texts are never paired with each other.
    """
    d = with_canonical(spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"))), "text", "form")
    d = stored(d.where("id is not null and form <> ''").select("id", F.sha2("form", 256).alias("form"), F.sha2("text", 256).alias("raw")), "forms")
    several = d.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    d = d.join(several, "form", "left_semi")
    variants = d.groupBy("form", "raw").agg(F.min("id").alias("first"))
    pairs = variants.alias("a").join(variants.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.raw") < F.col("b.raw"))).select(F.col("a.raw").alias("ra"), F.col("b.raw").alias("rb"))
    from quern.llm.simjoin import expanded

    members = stored(d.select(F.col("raw").alias("rep"), "id"), "members")
    return expanded(pairs, members, "ra", "rb").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def form_classes(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per record: its form and the smallest id that has this form (null and blank: its own id)."""
    d = with_canonical(spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"))), "text", "canonical")
    d = stored(d.select("id", "canonical", F.when(F.col("canonical") != "", F.sha2("canonical", 256)).alias("h")), "forms")
    low = d.where("h is not null").groupBy("h").agg(F.min("id").alias("class_id"))
    return d.join(low, "h", "left").select("id", "canonical", F.coalesce("class_id", "id").alias("class_id"))
