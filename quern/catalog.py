"""All queries of the core over whole tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import judge as J
from quern.functions import text as X
from quern.operators import agreement as A
from quern.operators import dedup as D
from quern.operators import merge as M
from quern.operators import stats as S
from quern.plans import annotate, preprocess
from quern.session import fresh_path, spread, table
from quern.sources import readers as R
from quern.streaming.incremental import merge_new

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable) -> Callable:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- SQL fragments

WS = X.WS


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def q_norm(x: str) -> str:
    return f"trim(regexp_replace(lower(nfc_normalize({x})), '{WS}+', ' ', 'g'))"


def q_file(x: str) -> str:
    return f"split_part(replace({x}, '\\', '/'), '/', -1)"


def q_suffix(x: str) -> str:
    return f"lower(regexp_extract({q_file(x)}, '(\\.[^.]+)$', 1))"


def q_tail(x: str) -> str:
    """The list without its repeated tail."""
    same = f"list_filter(range(1, len({x}) // 2 + 1), lambda k: {x}[len({x}) - k + 1 : len({x})] = {x}[len({x}) - 2 * k + 1 : len({x}) - k])"
    return f"CASE WHEN len({x}) < 2 THEN {x} ELSE {x}[1 : len({x}) - coalesce(list_max({same}), 0)] END"


# ---- cleaning a merged table

_KEPT_SQL = f"""
n AS (SELECT * FROM samples WHERE {q_strip('text')} <> '' AND {q_strip('image_path')} <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY {q_norm('text')} ORDER BY id) AS r FROM n)"""


def q_near(src: str) -> str:
    """Near links and the greedy choice over ``src``(id, t: normalised text): li (a, b, sim) of first rows of a signature, cp (a, b) of copies, dr (id) of what is dropped."""
    return f"""ws AS (SELECT id, t, string_split(t, ' ') AS w FROM {src}),
gr AS (SELECT id, CASE WHEN t = '' OR len(w) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM ws),
hs AS (SELECT id, list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM gr),
si AS (SELECT id, list_transform(range(0, 128), lambda i: list_min(list_transform(h, lambda x: xor(x, (2654435761 * i) & 4294967295)))) AS s FROM hs),
rp AS (SELECT min(id) AS id, s FROM si GROUP BY s),
cp AS (SELECT rp.id AS a, si.id AS b FROM si JOIN rp ON si.s = rp.s WHERE si.id <> rp.id),
pl AS (SELECT id, p, s[p] AS v FROM (SELECT id, s, unnest(range(1, 21)) AS p FROM rp)),
ca AS (SELECT DISTINCT x.id AS a, y.id AS b FROM pl x JOIN pl y ON x.p = y.p AND x.v = y.v AND x.id < y.id),
li AS (SELECT a, b, sim FROM (SELECT ca.a, ca.b, len(list_filter(list_zip(x.s, y.s), lambda z: z[1] = z[2])) / 128.0 AS sim FROM ca JOIN rp x ON x.id = ca.a JOIN rp y ON y.id = ca.b) WHERE sim >= 0.85),
nb AS (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM li GROUP BY b),
go(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nb.k, CASE WHEN len(list_filter(nb.before, lambda x: NOT list_contains(go.gone, x))) > 0 THEN list_append(go.gone, nb.id) ELSE go.gone END FROM go JOIN nb ON nb.k = go.k + 1),
dr AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM go ORDER BY k DESC LIMIT 1) UNION ALL SELECT b FROM cp)"""


_LISTING = "SELECT image_path AS path FROM samples WHERE image_path <> '' AND id % 5 <> 0"
_CLEANED = f"WITH RECURSIVE {_KEPT_SQL}, src AS (SELECT id, {q_norm('text')} AS t FROM e WHERE r = 1), {q_near('src')}"


@query(f"{_CLEANED} SELECT id AS old_id, row_number() OVER (ORDER BY id) AS id, text, image_path, source FROM e WHERE r = 1 AND id NOT IN (SELECT id FROM dr)")
def preprocess_kept(s, d):
    return preprocess.kept(table(s, d, "samples"))


@query(f"""{_CLEANED}, a AS (SELECT CASE WHEN n.id IS NULL THEN 'null' WHEN e.r > 1 THEN 'exact' WHEN dr.id IS NOT NULL THEN 'near' ELSE 'kept' END AS stage
FROM samples s LEFT JOIN n USING (id) LEFT JOIN e USING (id) LEFT JOIN dr USING (id)) SELECT stage, count(*) AS n_rows FROM a GROUP BY 1""")
def preprocess_stages(s, d):
    return preprocess.stage_report(table(s, d, "samples"))


@query(f"WITH {_KEPT_SQL} SELECT id AS old_id, row_number() OVER (ORDER BY id) AS id, text, image_path, source FROM e WHERE r = 1")
def preprocess_exact_only(s, d):
    return preprocess.kept(table(s, d, "samples"), near=False)


@query()
def preprocess_full(s, d):
    return preprocess.kept(table(s, d, "samples"), listing=_listing(s, d))


@query(f"SELECT id, coalesce({q_strip('text')} <> '' AND {q_strip('image_path')} <> '', false) AS is_kept FROM samples")
def null_filter(s, d):
    m = preprocess.null_marked(table(s, d, "samples"))
    return m.select("id", F.coalesce("is_kept", F.lit(False)).alias("is_kept"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 20")
def length_filter(s, d):
    return table(s, d, "documents").where(F.length("text") >= 20).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT id, source FROM (SELECT * FROM samples ORDER BY id LIMIT 1000) WHERE id >= 200")
def prefix_then_min_id(s, d):
    return D.head_then_least(table(s, d, "samples").select("id", "source"), "id", 1000, "id", 200)


_EXACT = f"WITH e AS (SELECT id, row_number() OVER (PARTITION BY coalesce({q_norm('text')}, '') ORDER BY id) AS r FROM samples)"


@query(f"{_EXACT} SELECT id FROM e WHERE r = 1")
def exact_dedup_kept(s, d):
    return D.exact_marked(table(s, d, "samples")).where("is_kept").select("id")


@query(f"{_EXACT} SELECT id FROM e WHERE r > 1")
def exact_dedup_dropped(s, d):
    return D.exact_marked(table(s, d, "samples")).where("NOT is_kept").select("id")


@query(f"SELECT id, {q_norm('text')} AS normal FROM samples")
def normalized_text(s, d):
    return table(s, d, "samples").select("id", X.normalized(F.col("text")).alias("normal"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS new_id FROM documents")
def reassign_ids(s, d):
    return D.numbered(table(s, d, "documents").select("doc_id"), "doc_id", "new_id")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 8)::BIGINT AS batch_id FROM documents")
def batch_ids(s, d):
    return D.batches(table(s, d, "documents").select("doc_id"), "doc_id", 8)


_GRAMS = f"""WITH n AS (SELECT id, coalesce({q_norm('text')}, '') AS t FROM samples),
w AS (SELECT id, t, string_split(t, ' ') AS w FROM n),
g AS (SELECT id, CASE WHEN t = '' OR len(w) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w)"""


@query(f"{_GRAMS} SELECT id, len(g)::BIGINT AS n_shingles FROM g")
def shingle_count(s, d):
    normal = table(s, d, "samples").select("id", F.coalesce(X.normalized(F.col("text")), F.lit("")).alias("t"))
    return normal.select("id", F.size(X.word_grams(F.col("t"))).cast("bigint").alias("n_shingles"))


@query(f"""{_GRAMS}, h AS (SELECT id, ('0x' || substr(md5(unnest(g)), 1, 8))::BIGINT AS h FROM g)
SELECT id, min(h) AS s0, min(xor(h, (2654435761 * 1) & 4294967295)) AS s1, min(xor(h, (2654435761 * 64) & 4294967295)) AS s64, min(xor(h, (2654435761 * 127) & 4294967295)) AS s127 FROM h GROUP BY 1""")
def minhash_signature(s, d):
    m = D.minhash(spread(table(s, d, "samples").select("id", "text")))
    return m.select("id", *[F.col("signature")[i].alias(f"s{i}") for i in (0, 1, 64, 127)])


_ALL_NEAR = f"WITH RECURSIVE src AS (SELECT id, coalesce({q_norm('text')}, '') AS t FROM samples), {q_near('src')}"


@query(f"{_ALL_NEAR} SELECT a, b, sim::DOUBLE AS similarity FROM li UNION ALL SELECT a, b, 1.0 FROM cp")
def near_links(s, d):
    return D.near_links(D.minhash(spread(table(s, d, "samples").select("id", "text"))))


@query(f"{_ALL_NEAR} SELECT id FROM src WHERE id NOT IN (SELECT id FROM dr)")
def near_dedup_kept(s, d):
    return D.near_marked(table(s, d, "samples").select("id", "text")).where("is_kept").select("id")


# ---- scraped sessions

_ORDER = "session, coalesce(scraped_at, ''), coalesce(text, '')"


@query(f"""SELECT post_link, session, username FROM (SELECT *, row_number() OVER (PARTITION BY post_link ORDER BY {_ORDER}) AS r
FROM thread_sessions WHERE post_link IS NOT NULL) WHERE r = 1""")
def keep_first_link(s, d):
    t = table(s, d, "thread_sessions").withColumn("o", F.struct("session", F.coalesce("scraped_at", F.lit("")), F.coalesce("text", F.lit(""))))
    return D.first_by(t, "post_link", "o").select("post_link", "session", "username")


@query("""SELECT post_link, session, text FROM (SELECT *, row_number() OVER (PARTITION BY post_link ORDER BY coalesce(scraped_at, '') DESC, session DESC, coalesce(text, '') DESC) AS r
FROM thread_sessions WHERE post_link IS NOT NULL) WHERE r = 1""")
def keep_last_link(s, d):
    t = table(s, d, "thread_sessions").withColumn("o", F.struct(F.coalesce("scraped_at", F.lit("")), "session", F.coalesce("text", F.lit(""))))
    return D.first_by(t, "post_link", "o", last=True).select("post_link", "session", "text")


@query(f"""WITH m AS (SELECT max(session) AS last FROM thread_sessions), old AS (SELECT post_link FROM thread_sessions, m WHERE session < last),
f AS (SELECT t.*, row_number() OVER (PARTITION BY post_link ORDER BY {_ORDER}) AS r FROM thread_sessions t, m
      WHERE session = last AND {q_strip('post_link')} <> '' AND post_link NOT IN (SELECT post_link FROM old WHERE post_link IS NOT NULL))
SELECT post_link, session, username FROM f WHERE r = 1""")
def merge_new_links(s, d):
    t = table(s, d, "thread_sessions").withColumn("o", F.struct("session", F.coalesce("scraped_at", F.lit("")), F.coalesce("text", F.lit(""))))
    last = t.agg(F.max("session").alias("m")).first()["m"]
    return M.new_by_key(t.where(F.col("session") == last), t.where(F.col("session") < last), "post_link", "o").select("post_link", "session", "username")


@query("""SELECT id, source, NULL::TIMESTAMP AS received_at FROM samples UNION ALL SELECT id, source, received_at FROM incoming_posts""")
def merge_append(s, d):
    old, new = table(s, d, "samples").select("id", "source"), table(s, d, "incoming_posts").select("id", "source", "received_at")
    return M.appended(old, new).select("id", "source", "received_at")


def _above(mode: str):
    def run(s, d):
        posts = table(s, d, "samples")
        return M.above(posts.where("source = 'threads'").select("id"), M.watermark(posts, mode))

    return run


QUERIES["watermark_by_count"] = _above("count")
ORACLE_SQL["watermark_by_count"] = "SELECT id FROM samples WHERE source = 'threads' AND id > (SELECT count(*) FROM samples WHERE source = 'threads')"
QUERIES["watermark_by_max_id"] = lambda s, d: M.above(table(s, d, "incoming_posts").select("id"), M.watermark(table(s, d, "samples"), "max_id"))
ORACLE_SQL["watermark_by_max_id"] = "SELECT id FROM incoming_posts WHERE id > (SELECT coalesce(max(id), 0) FROM samples WHERE source = 'threads')"


@query("SELECT coalesce(max(id), 0) + 1 AS next_id FROM samples")
def next_id(s, d):
    return s.createDataFrame([(M.next_id(table(s, d, "samples")),)], "next_id bigint")


@query(f"""SELECT coalesce(CASE WHEN coalesce({q_strip('text')}, '') = '' THEN 'empty_text' WHEN coalesce({q_strip('image_path')}, '') = '' THEN 'no_image'
WHEN NOT (image_path LIKE '%.jpg') THEN 'missing_image' END, 'kept') AS stage, count(*) AS n_rows FROM samples GROUP BY 1""")
def skip_reasons(s, d):
    t = table(s, d, "samples")
    return M.stage_counts(t, M.skip_reason(F.col("text"), F.col("image_path"), F.col("image_path").endswith(".jpg")))


_CLEAN = rf"""
a AS (SELECT *, {q_strip(f"regexp_replace({q_strip('text')}, '(?i)^(?:(?:thịnh hành|thread đầu tiên){WS}*)+', '')")} AS t0 FROM src),
b AS (SELECT *, CASE WHEN NOT contains(lower(t0), 'tiết lộ nội dung') THEN t0 END AS t1, regexp_extract(t0, '(?i)đang trả lời @{X.WORD}+{WS}*') AS reply FROM a),
c AS (SELECT *, CASE WHEN t1 IS NULL THEN NULL WHEN reply = '' THEN t1
  WHEN {q_strip("t1[1 : strpos(t1, reply) - 1]")} <> '' THEN {q_strip("t1[1 : strpos(t1, reply) - 1]")} ELSE {q_strip("t1[strpos(t1, reply) + length(reply) :]")} END AS t2 FROM b),
d AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t2, '@{X.WORD}+', 'username', 'g'), chr(10)), lambda x: {q_strip('x')}), lambda x: x <> '') AS l0 FROM c),
e AS (SELECT *, list_transform(l0, lambda x: CASE WHEN suffix(lower(x), ' dịch') THEN {q_strip("x[1 : length(x) - 5]")} ELSE x END) AS l FROM d),
f AS (SELECT *, list_transform(l, lambda x: contains(lower(x), 'đã đăng lại')) AS rep,
  list_transform(l, lambda x: NOT contains(lower(x), 'đã đăng lại') AND (regexp_matches(lower(x), '{X.AGO}') OR regexp_matches(x, '{X.DATE}') OR contains(lower(x), 'vừa xong'))) AS st,
  list_transform(l, lambda x: lower(x) = 'dịch' OR regexp_matches(x, '{X.COUNT}') OR x = '/') AS dr,
  list_transform(l, lambda x: len(list_filter(regexp_split_to_array(x, '{WS}+'), lambda w: w <> '')) <= 5) AS sh FROM e),
g AS (SELECT *, list_filter(l, lambda x, i: NOT (rep[i] OR (i > 1 AND rep[i - 1]) OR dr[i] OR st[i] OR coalesce(st[i + 1], false) OR (coalesce(st[i + 2], false) AND sh[i]))) AS k0 FROM f),
h AS (SELECT *, list_filter(k0, lambda x, i: NOT (regexp_matches(x, '{X.SLIDE}') AND i < len(k0))) AS k1 FROM g),
j AS (SELECT *, list_filter(k1, lambda x, i: i = 1 OR x <> k1[i - 1]) AS k2 FROM h),
m AS (SELECT *, nullif({q_strip(f"array_to_string({q_tail('k2')}, chr(10))")}, '') AS clean FROM j)"""


@query(f"WITH src AS (SELECT session, post_link, scraped_at, text FROM thread_sessions), {_CLEAN} SELECT session, post_link, scraped_at, clean FROM m")
def thread_clean(s, d):
    t = spread(table(s, d, "thread_sessions").select("session", "post_link", "scraped_at", "text"))
    return X.clean_threads(t).select("session", "post_link", "scraped_at", "clean")


_IMAGES = "list_filter(coalesce(image_local, []), lambda x: coalesce(trim(x), '') <> '')"


@query(f"""WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_link ORDER BY {_ORDER}) AS r FROM thread_sessions WHERE {q_strip('post_link')} <> '') WHERE r = 1),
src AS (SELECT *, {_IMAGES} AS i FROM u), {_CLEAN.replace("FROM src)", "FROM src WHERE len(i) > 0)")},
z AS (SELECT *, row_number() OVER (ORDER BY session, post_link) AS id FROM m WHERE clean IS NOT NULL),
y AS (SELECT *, list_transform(i, lambda x, n: 'images/' || 'post' || lpad(id::VARCHAR, greatest(5, length(id::VARCHAR))::INT, '0') || '_img' || lpad(n::VARCHAR, 2, '0') || {q_suffix('x')}) AS p FROM z)
SELECT id, clean AS text, p[1] AS image_path, len(p)::BIGINT AS n_images, post_link, username, keyword, mode, scraped_at FROM y""")
def merged_threads(s, d):
    m = M.merged_threads(spread(table(s, d, "thread_sessions")))
    return m.withColumn("n_images", F.coalesce(F.size("image_paths"), F.lit(1)).cast("bigint")).drop("image_paths")


def _lines(s, d):
    return spread(table(s, d, "thread_sessions").select("session", "post_link", "scraped_at", "text")).withColumn("l", F.split("text", "\n"))


_KEY = "session, post_link, scraped_at"


@query(f"SELECT {_KEY}, regexp_replace(text, '@{X.WORD}+', 'username', 'g') AS masked FROM thread_sessions")
def handle_mask(s, d):
    return table(s, d, "thread_sessions").select("session", "post_link", "scraped_at", X.mask_handles(F.col("text")).alias("masked"))


@query(f"""WITH a AS (SELECT *, regexp_extract(text, '(?i)đang trả lời @{X.WORD}+{WS}*') AS r FROM thread_sessions)
SELECT {_KEY}, CASE WHEN r = '' OR r IS NULL THEN text WHEN {q_strip("text[1 : strpos(text, r) - 1]")} <> '' THEN {q_strip("text[1 : strpos(text, r) - 1]")} ELSE {q_strip("text[strpos(text, r) + length(r) :]")} END AS side FROM a""")
def reply_side(s, d):
    return table(s, d, "thread_sessions").select("session", "post_link", "scraped_at", X.keep_reply_side(F.col("text")).alias("side"))


@query(f"WITH a AS (SELECT *, string_split(text, chr(10)) AS l FROM thread_sessions) SELECT {_KEY}, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)) AS lines FROM a")
def adjacent_line_dedup(s, d):
    return _lines(s, d).select("session", "post_link", "scraped_at", F.array_join(X.distinct_neighbours(F.col("l")), "\n").alias("lines"))


@query(f"WITH a AS (SELECT *, string_split(text, chr(10)) AS l FROM thread_sessions) SELECT {_KEY}, array_to_string({q_tail('l')}, chr(10)) AS lines FROM a")
def block_dedup(s, d):
    return _lines(s, d).select("session", "post_link", "scraped_at", F.array_join(X.drop_repeated_tail(F.col("l")), "\n").alias("lines"))


def q_halve(x: str, least: int) -> str:
    a, b = q_strip(f"{x}[1 : length({x}) // 2]"), q_strip(f"{x}[length({x}) // 2 + 1 :]")
    return f"CASE WHEN length({x}) > {least} AND length({x}) > 0 AND {a} = {b} THEN {a} ELSE {x} END"


_DOUBLED = "SELECT id, CASE WHEN id % 3 = 0 THEN text || ' ' || text WHEN id % 3 = 1 THEN text || text ELSE text END AS t FROM samples"


def _doubled(s, d):
    t = F.col("text")
    return table(s, d, "samples").select("id", F.when(F.col("id") % 3 == 0, F.concat(t, F.lit(" "), t)).when(F.col("id") % 3 == 1, F.concat(t, t)).otherwise(t).alias("t"))


@query(f"WITH a AS ({_DOUBLED}) SELECT id, {q_halve('t', 0)} AS half FROM a")
def half_dedup(s, d):
    return _doubled(s, d).select("id", X.halve_repeated(F.col("t")).alias("half"))


def q_caption(x: str) -> str:
    """Three patterns taken out. RE2 knows only ASCII word limits: other letters get underscores (word characters) around them meanwhile."""
    marked = f"replace(regexp_replace(regexp_replace(replace({x}, '_', '_' || chr(57344) || '_'), '([^\\x00-\\x7F\\x{{E000}}])', chr(57345) || '\\1' || chr(57345), 'g'), '\\x{{E001}}([\\p{{L}}\\p{{Nd}}\\p{{M}}])\\x{{E001}}', '_\\1_', 'g'), chr(57345), '')"
    for pattern in (r"(?:\b[a-zA-Z0-9]\s){2,}[a-zA-Z0-9]\b", r"\S+\.[a-z]{2,4}\b", r"\b[a-zA-Z0-9]{15,}\b"):
        marked = f"regexp_replace({marked}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace(replace(replace({marked}, '_', ''), chr(57344), '_'), '{WS}+', ' ', 'g'))"


@query(f"WITH a AS ({_DOUBLED}), b AS (SELECT id, {q_halve('t', 20)} AS t FROM a) SELECT id, {q_caption('t')} AS caption FROM b")
def caption_clean(s, d):
    return _doubled(s, d).select("id", X.clean_caption(F.col("t")).alias("caption"))


_LINES_ONCE = f"array_to_string({q_tail('l')}, chr(10))"


@query(f"""WITH a AS ({_DOUBLED}), b AS (SELECT id, {q_strip('t')} AS t FROM a), c AS (SELECT id, string_split(t, chr(10)) AS l FROM b),
e AS (SELECT id, {q_strip(_LINES_ONCE)} AS t FROM c) SELECT id, nullif({q_halve('t', 0)}, '') AS clean FROM e""")
def facebook_clean(s, d):
    return _doubled(s, d).select("id", X.clean_facebook(F.col("t")).alias("clean"))


@query(f"""WITH a AS (SELECT *, list_filter(list_concat(coalesce(image_local, []), coalesce(image_local, [])), lambda x: length(x) >= 3) AS l FROM thread_sessions)
SELECT {_KEY}, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS parts FROM a""")
def distinct_parts(s, d):
    """Each list twice over, so every row has repeats."""
    i = F.coalesce("image_local", F.array().cast("array<string>"))
    return table(s, d, "thread_sessions").select("session", "post_link", "scraped_at", X.joined_parts(F.concat(i, i)).alias("parts"))


@query("SELECT id, CASE WHEN regexp_extract(u, '/([0-9]{9,})[_.]', 1) <> '' THEN regexp_extract(u, '/([0-9]{9,})[_.]', 1) ELSE u END AS image_id FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'https://cdn.example/v/' || (id + 123456789) || '_n.jpg' ELSE image_path END AS u FROM samples)")
def image_id_extract(s, d):
    u = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://cdn.example/v/"), (F.col("id") + 123456789).cast("string"), F.lit("_n.jpg"))).otherwise(F.col("image_path"))
    return table(s, d, "samples").select("id", X.image_id(u).alias("image_id"))


# ---- images

@query(f"SELECT id, 'post' || lpad(id::VARCHAR, greatest(5, length(id::VARCHAR))::INT, '0') || {q_suffix('image_path')} AS name FROM samples WHERE image_path IS NOT NULL")
def image_name_format(s, d):
    return table(s, d, "samples").where("image_path IS NOT NULL").select("id", X.post_image_name(F.col("id"), F.col("image_path")).alias("name"))


def _listing(s, d):
    return table(s, d, "samples").where("image_path <> '' AND id % 5 <> 0").select(F.col("image_path").alias("path"))


@query(f"SELECT id FROM incoming_posts WHERE replace(image_path, 'threads_merged', 'merged_dataset') IN ({_LISTING}) UNION ALL SELECT id FROM samples WHERE image_path IN ({_LISTING})")
def exists_semi(s, d):
    files = _listing(s, d)
    a = table(s, d, "incoming_posts").select("id", F.replace("image_path", F.lit("threads_merged"), F.lit("merged_dataset")).alias("path"))
    b = table(s, d, "samples").select("id", F.col("image_path").alias("path"))
    return preprocess.with_files(a, files).select("id").unionAll(preprocess.with_files(b, files).select("id"))


@query(f"SELECT id, CASE WHEN there THEN 1 ELSE 0 END AS n_images, coalesce(trim(image_path) <> '' AND there IS NULL, false) AS image_missing FROM samples LEFT JOIN (SELECT DISTINCT path, true AS there FROM ({_LISTING})) ON path = image_path")
def image_missing(s, d):
    t = table(s, d, "samples").withColumn("image_paths", F.lit(None).cast("array<string>"))
    files = _listing(s, d).select(F.concat(F.lit("data/"), "path").alias("path"))
    return R.loaded_images(t, files, ["other/", "data/"]).select("id", F.size("images").alias("n_images"), "image_missing")


@query(f"""WITH r AS (SELECT id + (id % 2) AS id, {q_file('image_path')} AS cur FROM samples WHERE {q_strip('image_path')} <> ''),
t AS (SELECT *, 'post' || lpad(id::VARCHAR, greatest(5, length(id::VARCHAR))::INT, '0') || {q_suffix('cur')} AS target FROM r),
f AS (SELECT DISTINCT {q_file('path')} AS cur, true AS there FROM ({_LISTING})), l AS (SELECT id FROM samples WHERE id % 20 = 0)
SELECT t.id, t.cur AS current, target, CASE WHEN t.cur = target THEN 'no_change' WHEN there THEN 'renamed' WHEN l.id IS NOT NULL THEN 'recovered' ELSE 'missing' END AS state
FROM t LEFT JOIN f USING (cur) LEFT JOIN l ON l.id = t.id""")
def rename_plan(s, d):
    t = table(s, d, "samples")
    left = M.leftover_ids(t.where("id % 20 = 0").select(F.format_string("images/tmp_%d.jpg", F.col("id")).alias("path")))
    return M.rename_plan(t.select((F.col("id") + F.col("id") % 2).alias("id"), "image_path"), _listing(s, d), left)


# ---- annotation

_PARSE = r"""
v AS (SELECT id, coalesce(nullif(regexp_extract(regexp_replace(coalesce(raw1, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)\{.*\}'), ''), trim(regexp_replace(coalesce(raw1, ''), '(?s)<think>.*?</think>', '', 'g'))) AS t1,
  coalesce(nullif(regexp_extract(regexp_replace(coalesce(raw2, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)\{.*\}'), ''), trim(regexp_replace(coalesce(raw2, ''), '(?s)<think>.*?</think>', '', 'g'))) AS t2 FROM judge_replies),
p AS (SELECT id, CASE WHEN json_valid(t1) THEN t1::JSON END AS j1, CASE WHEN json_valid(t2) THEN t2::JSON END AS j2 FROM v),
o AS (SELECT id, CASE WHEN json_type(j1) = 'OBJECT' THEN j1 WHEN j1 IS NULL AND json_type(j2) = 'OBJECT' THEN j2 END AS j, j1 IS NOT NULL AS first FROM p)"""


def q_bit(field: str) -> str:
    kind, text = f"json_type(j, '$.{field}')", f"json_extract_string(j, '$.{field}')"
    return f"CASE WHEN {kind} = 'VARCHAR' THEN CASE WHEN {text} IN ('0', '1') THEN {text}::INT END WHEN {kind} = 'BOOLEAN' THEN ({text} = 'true')::INT WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND try_cast({text} AS DOUBLE) IN (0, 1) THEN try_cast({text} AS DOUBLE)::INT END"


@query(f"""WITH {_PARSE} SELECT id, coalesce(({q_bit('llm_label')})::VARCHAR, 'INVALID') AS label, {q_bit('has_emoji')} AS has_emoji, {q_bit('needs_human_check')} AS needs_human_check,
CASE WHEN j IS NULL THEN CASE WHEN first THEN '{J.UNEXPECTED}' ELSE '{J.REPAIR_FAILED}' END ELSE left(coalesce(nullif(json_extract_string(j, '$.notes'), ''), nullif(json_extract_string(j, '$.Notes'), ''), ''), 500) END AS notes,
CASE WHEN json_type(j, '$.reasoning') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.reasoning'), '') ELSE json_extract_string(j, '$.reasoning.verdict') END AS verdict, j IS NULL AS parse_error FROM o""")
def judge_parse_validate(s, d):
    r = annotate.read_replies(table(s, d, "judge_replies"))
    return r.select("id", "label", "has_emoji", "needs_human_check", "notes", F.try_element_at("reasoning", F.lit("verdict")).alias("verdict"), "parse_error")


_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(label_llm1, '') DESC, coalesce(has_emoji, -1) DESC, coalesce(needs_human_check, -1) DESC, coalesce(notes, '') DESC,
  coalesce(parse_error, false) DESC, coalesce(image_missing, false) DESC, coalesce(map_extract(reasoning, 'verdict')[1], '') DESC, coalesce(cardinality(reasoning), -1) DESC) AS r FROM judge_records WHERE id IS NOT NULL) WHERE r = 1),
routed AS (SELECT s.id, s.text, s.image_path, reasoning, label_llm1, has_emoji, needs_human_check, CASE WHEN image_missing THEN 'missing_image' WHEN parse_error THEN 'invalid_json' END AS o FROM samples s JOIN last USING (id)),
r AS (SELECT *, CASE WHEN o = 'invalid_json' THEN 'invalid' WHEN label_llm1 = '1' THEN 'sarcastic' WHEN label_llm1 = '0' THEN 'non_sarcastic' ELSE 'invalid' END AS round1_label,
  CASE WHEN o IS NOT NULL THEN o WHEN label_llm1 IS NULL OR label_llm1 NOT IN ('0', '1') THEN 'uncertain' WHEN needs_human_check = 0 THEN 'high_conf' ELSE 'low_conf' END AS route_reason FROM routed),
x AS (SELECT *, route_reason <> 'high_conf' AS need_review FROM r)"""


def _routed(s, d):
    def order() -> Column:
        none = lambda c, v: F.coalesce(c, F.lit(v))
        return F.struct(none("label_llm1", ""), none("has_emoji", -1), none("needs_human_check", -1), none("notes", ""), none("parse_error", False), none("image_missing", False), none(F.try_element_at("reasoning", F.lit("verdict")), ""), F.when(F.col("reasoning").isNull(), -1).otherwise(F.size("reasoning")))

    return annotate.routed(table(s, d, "samples"), table(s, d, "judge_records").withColumn("o", order()), "o", stamp="2025-01-01T00:00:00Z")


@query(f"WITH {_LAST} SELECT id, round1_label, route_reason, need_review FROM x")
def route_records(s, d):
    return _routed(s, d).select("id", "round1_label", "route_reason", "need_review")


@query(f"WITH {_LAST} SELECT id FROM x WHERE NOT need_review")
def auto_accepted(s, d):
    return annotate.outputs(_routed(s, d))["auto_accepted"].select("id")


@query(f"WITH {_LAST} SELECT id, route_reason FROM x WHERE need_review")
def human_queue(s, d):
    return annotate.outputs(_routed(s, d))["human_queue"].select("id", "route_reason")


@query(f"WITH {_LAST} SELECT id, text, image_path, label_llm1, has_emoji, needs_human_check, map_extract(reasoning, 'verdict')[1] AS verdict, cardinality(reasoning)::INT AS n_reasons, '2025-01-01T00:00:00Z' AS timestamp FROM x")
def slim_projection(s, d):
    r = annotate.slim(_routed(s, d))
    return r.withColumns({"verdict": F.try_element_at("reasoning", F.lit("verdict")), "n_reasons": F.when(F.col("reasoning").isNotNull(), F.size("reasoning"))}).drop("reasoning")


_STATS = [("labels", "round1_label", ["sarcastic", "non_sarcastic", "invalid"]), ("has_emoji", "coalesce(has_emoji::VARCHAR, 'null')", ["0", "1", "null"]), ("needs_human_check", "coalesce(needs_human_check::VARCHAR, 'null')", ["0", "1", "null"]), ("reasons", "route_reason", ["high_conf", "low_conf", "uncertain", "missing_image", "invalid_json", "audit_sampled"])]


@query(f"""WITH {_LAST} SELECT count(*) AS total, (SELECT count(*) FROM samples) - count(*) AS bad_count, count(*) FILTER (need_review) AS need_review, count(*) FILTER (NOT need_review) AS auto_accepted,
round(count(*) FILTER (need_review) / count(*), 4) AS review_rate, round(count(*) FILTER (NOT need_review) / count(*), 4) AS auto_rate,
{', '.join(f"count(*) FILTER ({c} = '{v}') AS {m}_{v}" for m, c, values in _STATS for v in values)} FROM x""")
def route_stats(s, d):
    r = S.routed_stats(_routed(s, d), table(s, d, "samples").count())
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).alias(f"{m}_{k}")
    return r.select("total", "bad_count", "need_review", "auto_accepted", "review_rate", "auto_rate", *[at(m, v) for m, _, values in _STATS for v in values])


@query(f"WITH {_LAST} SELECT v.value, count(x.id) AS n_rows FROM (VALUES ('sarcastic'), ('non_sarcastic'), ('invalid'), ('other')) v(value) LEFT JOIN x ON x.round1_label = v.value GROUP BY 1")
def label_distribution_zero_filled(s, d):
    return S.zero_filled(_routed(s, d), F.col("round1_label"), [*J.LABELS, "other"])


@query("SELECT v.value, count(j.k) AS n_rows FROM (VALUES ('0'), ('1'), ('null')) v(value) LEFT JOIN (SELECT coalesce(has_emoji::VARCHAR, 'null') AS k FROM judge_records) j ON j.k = v.value GROUP BY 1")
def null_bucket_distribution(s, d):
    return S.zero_filled(table(s, d, "judge_records"), S.null_bucket(F.col("has_emoji")), ["0", "1", "null"])


@query(f"""WITH {_LAST}, k AS (SELECT round_even(count(*) * 0.05, 0)::BIGINT AS k FROM x),
a AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r FROM x WHERE round1_label IN ('sarcastic', 'non_sarcastic'))
SELECT x.id, round1_label, coalesce(a.r <= k.k, false) OR need_review AS need_review, CASE WHEN a.r <= k.k THEN 'audit_sampled' ELSE route_reason END AS route_reason FROM x LEFT JOIN a USING (id), k""")
def audit_sample(s, d):
    return D.audit_sample(_routed(s, d), 0.05, 42).select("id", "round1_label", "need_review", "route_reason")


@query("SELECT id FROM samples WHERE id NOT IN (SELECT id FROM judge_records WHERE id IS NOT NULL)")
def resume_remaining(s, d):
    return annotate.remaining(table(s, d, "samples"), table(s, d, "judge_records")).select("id")


@query("SELECT id FROM samples WHERE id IN (SELECT id FROM judge_records)")
def resume_cached(s, d):
    return annotate.cached(table(s, d, "samples"), table(s, d, "judge_records")).select("id")


@query("SELECT r.id, s.source, r.label_llm1 FROM judge_records r JOIN samples s USING (id)")
def progress_rows(s, d):
    return annotate.progress(table(s, d, "judge_records"), table(s, d, "samples")).select("id", "source", "label_llm1")


_TEMPLATE = "Text: {text}\nImages: {images}\nOCR: {ocr_text}"


@query("""SELECT id, replace(replace(replace('Text: {text}' || chr(10) || 'Images: {images}' || chr(10) || 'OCR: {ocr_text}', '{text}', coalesce(text, '')), '{images}',
CASE WHEN image_path <> '' THEN '1 image attached' ELSE 'no image' END), '{ocr_text}', coalesce(CASE WHEN trim(source) <> '' THEN source END, '(none)')) AS prompt FROM samples""")
def prompt_fill(s, d):
    t = table(s, d, "samples")
    return t.select("id", J.fill_prompt(_TEMPLATE, F.col("text"), F.when(F.col("image_path") != "", 1).otherwise(0), F.col("source")).alias("prompt"))


@query("""SELECT doc_id, greatest(1, floor(w * least(1.0, sqrt(250000.0 / (w * h))))::INT) AS width, greatest(1, floor(h * least(1.0, sqrt(250000.0 / (w * h))))::INT) AS height
FROM (SELECT doc_id, (100 + doc_id % 1500)::INT AS w, (80 + doc_id % 900)::INT AS h FROM documents)""")
def image_budget(s, d):
    t = table(s, d, "documents").select("doc_id", (100 + F.col("doc_id") % 1500).cast("int").alias("w"), (80 + F.col("doc_id") % 900).cast("int").alias("h"))
    return t.select("doc_id", J.budget_size(F.col("w"), F.col("h"), 250_000).alias("b")).select("doc_id", "b.width", "b.height")


@query("""SELECT id, CASE WHEN regexp_matches(text, '[🤡🙃🫠]') AND regexp_matches(lower(text), 'hết sức|quá trời|tuyệt vời|xuất sắc') THEN '1' ELSE '0' END AS label FROM samples""")
def judge_udf(s, d):
    return annotate.read_replies(annotate.judged(spread(table(s, d, "samples").select("id", "text")))).select("id", "label")


# ---- agreement

_HUMAN = """cand AS (SELECT id, try_cast(inner_id AS BIGINT) AS inner_id, data.text AS text,
  list_filter(annotations, lambda a: NOT coalesce(a.was_cancelled, false))[1].result AS res FROM label_tasks),
ch AS (SELECT *, list_filter(list_transform(flatten(list_transform(coalesce(res, []), lambda r: coalesce(r.value.choices, []))), lambda c: CASE WHEN contains(lower(trim(c)), 'not') THEN 0
  WHEN contains(lower(trim(c)), 'sarcastic') OR contains(lower(trim(c)), 'sacarstic') THEN 1 END), lambda y: y IS NOT NULL) AS ys FROM cand),
human AS (SELECT inner_id, text, ys[1] AS label FROM (SELECT *, row_number() OVER (PARTITION BY inner_id ORDER BY id) AS r FROM ch WHERE inner_id IS NOT NULL) WHERE r = 1)"""
_JUDGE = """judge AS (SELECT id AS llm_id, CASE WHEN label_llm1 <> 'INVALID' THEN try_cast(label_llm1 AS INT) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(label_llm1, ''), coalesce(notes, '')) AS r
  FROM judge_records WHERE id IS NOT NULL) WHERE r = 1)"""
_JOINED = f"""{_HUMAN}, {_JUDGE}, j AS (SELECT inner_id, inner_id - 1 AS llm_id, text, h.label AS label_human, g.label AS label_llm,
  CASE WHEN g.llm_id IS NULL THEN 'missing_llm' WHEN h.label IS NULL AND g.label IS NULL THEN 'invalid_both' WHEN h.label IS NULL THEN 'invalid_human' WHEN g.label IS NULL THEN 'invalid_llm' ELSE 'valid' END AS status
  FROM human h LEFT JOIN judge g ON g.llm_id = h.inner_id - 1)"""


def _human(s, d):
    return A.human_by_item(table(s, d, "label_tasks"))


def _judge(s, d):
    o = F.struct(F.coalesce("label_llm1", F.lit("")), F.coalesce("notes", F.lit("")))
    return A.judge_by_id(table(s, d, "judge_records").withColumn("o", o), "o").select("llm_id", "label")


def _joined(s, d):
    return A.joined(_human(s, d), _judge(s, d))


@query(f"WITH {_HUMAN} SELECT inner_id, label FROM human")
def human_label_extract(s, d):
    return _human(s, d).select("inner_id", "label")


@query(f"WITH {_JOINED} SELECT inner_id, llm_id, label_human, label_llm, status FROM j")
def iaa_two_way(s, d):
    return _joined(s, d).drop("text")


@query(f"""WITH {_JOINED} SELECT count(*) AS n_human, count(*) FILTER (status = 'missing_llm') AS missing_llm, count(*) FILTER (status IN ('invalid_human', 'invalid_both')) AS human_invalid,
count(*) FILTER (status IN ('invalid_llm', 'invalid_both')) AS llm_invalid, count(*) FILTER (status = 'valid') AS valid FROM j""")
def iaa_coverage(s, d):
    return A.coverage(_joined(s, d))


@query(f"WITH {_JOINED} SELECT inner_id, llm_id, text, label_human, CASE label_human WHEN 1 THEN 'sarcastic' ELSE 'not_sarcastic' END AS label_human_str, label_llm, CASE label_llm WHEN 1 THEN 'sarcastic' ELSE 'not_sarcastic' END AS label_llm_str FROM j WHERE status = 'valid' AND label_human <> label_llm")
def iaa_disagreements(s, d):
    return A.disagreements(_joined(s, d))


_BAND = "CASE WHEN k IS NULL OR isnan(k) THEN 'undefined' WHEN k < 0 THEN 'poor (less than chance)' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END"


@query(f"""WITH {_JOINED}, c AS (SELECT count(*) AS n, count(*) FILTER (label_human = label_llm) AS agree, count(*) FILTER (label_human = 1 AND label_llm = 1) AS tp, count(*) FILTER (label_human = 0 AND label_llm = 0) AS tn,
  count(*) FILTER (label_human = 0 AND label_llm = 1) AS fp, count(*) FILTER (label_human = 1 AND label_llm = 0) AS fn FROM j WHERE status = 'valid'),
p AS (SELECT *, agree / n AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe, ((2 * tp + fp + fn) / (2 * n)) ** 2 + (1 - (2 * tp + fp + fn) / (2 * n)) ** 2 AS fe FROM c),
z AS (SELECT *, round((po - pe) / (1 - pe), 6) AS ck, round((po - fe) / (1 - fe), 6) AS fk FROM p)
SELECT n, agree, n - agree AS conflict, round(100.0 * po, 2) AS agree_pct, tp, tn, fp, fn, ck AS cohen_kappa, fk AS fleiss_kappa, {_BAND.replace('k ', 'ck ').replace('(k)', '(ck)')} AS cohen_band, {_BAND.replace('k ', 'fk ').replace('(k)', '(fk)')} AS fleiss_band FROM z""")
def iaa_stats(s, d):
    return A.pair_stats(_joined(s, d).where("status = 'valid'"))


@query(f"WITH {_HUMAN}, {_JUDGE} SELECT llm_id FROM judge WHERE llm_id NOT IN (SELECT inner_id - 1 FROM human)")
def llm_only_ids(s, d):
    return A.unmatched(_judge(s, d), _human(s, d))


_VOTES = "v AS (SELECT inner_id, label_human AS y FROM rater_labels WHERE label_human IN (0, 1))"


@query(f"""WITH {_VOTES}, p AS (SELECT inner_id, count(*)::DOUBLE AS r, sum(y)::DOUBLE AS k FROM v GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT r::INT AS n_raters, count(*) AS n_items, avg((k * k + (r - k) * (r - k) - r) / (r * (r - 1))) AS po, sum(k) / sum(r) AS p1 FROM p GROUP BY r), e AS (SELECT *, p1 * p1 + (1 - p1) * (1 - p1) AS pe FROM g)
SELECT n_raters, n_items, CASE WHEN pe >= 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 6) END AS kappa FROM e""")
def fleiss_kappa(s, d):
    return A.fleiss(table(s, d, "rater_labels"), "inner_id", "label_human", [0, 1])


_KAPPAS = "(VALUES (-0.5), (0.0), (0.19), (0.2), (0.4), (0.6), (0.8), (1.0))"


@query(f"SELECT k::DOUBLE AS k, {_BAND} AS band FROM {_KAPPAS} v(k)")
def kappa_band(s, d):
    v = s.createDataFrame([(x,) for x in (-0.5, 0.0, 0.19, 0.2, 0.4, 0.6, 0.8, 1.0)], "k double")
    return v.select("k", A.kappa_band(F.col("k")).alias("band"))


@query("SELECT annotator, count(*) FILTER (label_human = 1) AS ones, count(*) FILTER (label_human = 0) AS zeros, count(*) FILTER (label_human IS NULL OR label_human NOT IN (0, 1)) AS others FROM rater_labels GROUP BY 1")
def labels_per_annotator(s, d):
    return A.labels_per_annotator(table(s, d, "rater_labels"))


_THREE = f"""{_HUMAN}, {_JUDGE}, a AS (SELECT inner_id AS k, label FROM human), b AS (SELECT inner_id AS k, max(label_human) AS label FROM rater_labels WHERE label_human IN (0, 1) OR label_human IS NULL GROUP BY 1),
c AS (SELECT llm_id + 1 AS k, label FROM judge),
t AS (SELECT coalesce(a.k, b.k, c.k) AS k, a.label AS label_1, b.label AS label_2, c.label AS label_llm, CASE WHEN a.k IS NULL THEN 'annotator_1' WHEN b.k IS NULL THEN 'annotator_2' WHEN c.k IS NULL THEN 'llm' END AS missing
  FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k))"""


@query(f"WITH {_THREE} SELECT *, missing IS NULL AND label_1 IS NULL AS invalid_1, missing IS NULL AND label_2 IS NULL AS invalid_2, missing IS NULL AND label_llm IS NULL AS invalid_llm FROM t")
def iaa_three_way(s, d):
    a = _human(s, d).select(F.col("inner_id").alias("k"), "label")
    b = table(s, d, "rater_labels").where("label_human IN (0, 1) OR label_human IS NULL").groupBy(F.col("inner_id").alias("k")).agg(F.max("label_human").alias("label"))
    c = _judge(s, d).select((F.col("llm_id") + 1).alias("k"), "label")
    return A.three_way(a, b, c, "k")


_BY_TEXT = f"""{_HUMAN},
ha AS (SELECT {q_strip('data.text')} AS k, ys[1] AS label, id FROM ch JOIN label_tasks USING (id) WHERE {q_strip('data.text')} <> ''), a AS (SELECT k, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM ha) WHERE r = 1),
jt AS (SELECT {q_strip('s.text')} AS k, CASE WHEN label_llm1 <> 'INVALID' THEN try_cast(label_llm1 AS INT) END AS label, id, coalesce(label_llm1, '') AS o1, coalesce(notes, '') AS o2 FROM judge_records JOIN samples s USING (id) WHERE {q_strip('s.text')} <> ''),
c AS (SELECT k, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id, o1, o2) AS r FROM jt) WHERE r = 1),
b AS (SELECT {q_strip('s.text')} AS k, max(label_human) AS label FROM rater_labels l JOIN samples s ON s.id = l.llm_id WHERE {q_strip('s.text')} <> '' AND (label_human IN (0, 1) OR label_human IS NULL) GROUP BY 1),
t AS (SELECT coalesce(a.k, b.k, c.k) AS text, a.label AS x, b.label AS y, c.label AS z, CASE WHEN a.k IS NULL THEN 'annotator_1' WHEN b.k IS NULL THEN 'annotator_2' WHEN c.k IS NULL THEN 'llm' END AS missing
  FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k)), w AS (SELECT * FROM t WHERE missing IS NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"""


def _by_text(s, d):
    posts = table(s, d, "samples").select("id", "text")
    first = A.human_by_text(table(s, d, "label_tasks")).select(F.col("key").alias("text"), "label")
    labels = table(s, d, "rater_labels").where("label_human IN (0, 1) OR label_human IS NULL").join(posts.withColumnRenamed("id", "llm_id"), "llm_id").withColumn("text", X.blank_to_null(X.strip(F.col("text"))))
    second = labels.where("text IS NOT NULL").groupBy("text").agg(F.max("label_human").alias("label"))
    order = F.struct("id", F.coalesce("label_llm1", F.lit("")), F.coalesce("notes", F.lit("")))
    judge = A.judge_by_text(table(s, d, "judge_records").join(posts, "id").withColumn("o", order), "o").select(F.col("key").alias("text"), "label")
    return A.three_way(first, second, judge)


@query(f"WITH {_BY_TEXT} SELECT k AS key, label FROM a")
def human_by_text(s, d):
    return A.human_by_text(table(s, d, "label_tasks")).select("key", "label")


@query(f"WITH {_BY_TEXT} SELECT k AS key, label FROM c")
def judge_by_text(s, d):
    order = F.struct("id", F.coalesce("label_llm1", F.lit("")), F.coalesce("notes", F.lit("")))
    return A.judge_by_text(table(s, d, "judge_records").join(table(s, d, "samples").select("id", "text"), "id").withColumn("o", order), "o").select("key", "label")


@query(f"""WITH {_BY_TEXT}, f AS (SELECT avg(((x + y + z) ** 2 + (3 - x - y - z) ** 2 - 3) / 6.0) AS po, avg(x + y + z) / 3.0 AS p1 FROM w), e AS (SELECT *, p1 * p1 + (1 - p1) * (1 - p1) AS pe FROM f),
n AS (SELECT count(*) AS n_valid, count(*) FILTER (x = y AND y = z) AS n_all_agree, {', '.join(f"count(*) FILTER ({c} = {v}) AS {k}_{m}" for k, c in (("first", "x"), ("second", "y"), ("llm", "z")) for v, m in ((1, "sarcastic"), (0, "not_sarcastic")))} FROM w),
u AS (SELECT count(*) AS n_union, count(*) FILTER (missing IS NULL) AS n_all_present, {', '.join(f"count(*) FILTER (missing = '{m}') AS missing_{m}" for m in ("annotator_1", "annotator_2", "llm"))},
  {', '.join(f"count(*) FILTER (missing IS NULL AND {c} IS NULL) AS invalid_{k}" for k, c in (("1", "x"), ("2", "y"), ("llm", "z")))} FROM t), q AS (SELECT CASE WHEN pe >= 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 4) END AS k FROM e)
SELECT u.*, n.*, n_valid - n_all_agree AS n_any_conflict, round(100.0 * n_all_agree / n_valid, 2) AS all_agree_pct, k AS fleiss_kappa, {_BAND} AS fleiss_band FROM u, n, q""")
def iaa_three_way_report(s, d):
    return A.three_way_report(_by_text(s, d))


@query(f"""WITH {_BY_TEXT}, p AS (SELECT '1' AS a, '2' AS b, x AS p, y AS q FROM w UNION ALL SELECT '1', 'llm', x, z FROM w UNION ALL SELECT '2', 'llm', y, z FROM w)
SELECT a, b, count(*) AS n, count(*) FILTER (p = q) AS agree, count(*) FILTER (p = 1 AND q = 1) AS tp, count(*) FILTER (p = 0 AND q = 0) AS tn, count(*) FILTER (p = 0 AND q = 1) AS fp, count(*) FILTER (p = 1 AND q = 0) AS fn FROM p GROUP BY 1, 2""")
def iaa_pairwise(s, d):
    return A.pairwise(_by_text(s, d)).select("a", "b", "n", "agree", "tp", "tn", "fp", "fn")


@query(f"""WITH {_BY_TEXT} SELECT 'missing_' || missing AS reason, text[1:60] AS key FROM t WHERE missing IS NOT NULL UNION ALL SELECT 'invalid_1', text[1:60] FROM t WHERE missing IS NULL AND x IS NULL
UNION ALL SELECT 'invalid_2', text[1:60] FROM t WHERE missing IS NULL AND y IS NULL UNION ALL SELECT 'invalid_llm', text[1:60] FROM t WHERE missing IS NULL AND z IS NULL""")
def iaa_skipped(s, d):
    return A.skipped(_by_text(s, d))


@query(f"WITH {_BY_TEXT} SELECT text, x AS label_1, y AS label_2, z AS label_llm FROM w WHERE x <> y")
def iaa_conflicts(s, d):
    return A.conflicts(_by_text(s, d)).select("text", "label_1", "label_2", "label_llm")


@query("SELECT id, inner_id FROM label_tasks WHERE len(annotations) > 0")
def only_annotated(s, d):
    return A.annotated(table(s, d, "label_tasks")).select("id", "inner_id")


@query("SELECT count(*) AS n_tasks, count(*) FILTER (len(annotations) > 0) AS n_annotated FROM label_tasks")
def export_counts(s, d):
    return A.export_counts(table(s, d, "label_tasks"))


@query("SELECT id, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM incoming_posts")
def utc_stamp(s, d):
    return table(s, d, "incoming_posts").select("id", J.utc_stamp(F.col("received_at")).alias("stamp"))


# ---- incremental

@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def stream_dedup(s, d):
    """Rows arrive as a file stream; the first of each key is kept in a table that later batches are held against."""
    source, target = fresh_path(s, "arrivals"), fresh_path(s, "merged")
    table(s, d, "events").select("event_id", "user_id").write.parquet(source)
    stream = s.readStream.schema("event_id bigint, user_id bigint").parquet(source)
    merge_new(s, stream, target, "user_id", "event_id", fresh_path(s, "offsets"))
    return s.read.parquet(target).select("event_id", "user_id")
