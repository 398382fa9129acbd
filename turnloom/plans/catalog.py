"""The registered queries over the driver's tables, each with the SQL that checks it.

The tables hold no share links and no provider markup, so queries derive what they need from ids, the
same way in Spark and in SQL: links and markers by an id modulo a number, repeats by a union with later
positions, pages of a provider from conversation texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import rules, text
from turnloom.functions.sanitize import sanitize_html
from turnloom.operators import admission, candidates, capture, embedded, guides, messages, nodes, providers, render, table_functions
from turnloom.plans import pages as share
from turnloom.plans import streams
from turnloom.sources.tables import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# -- SQL forms of the text functions ---------------------------------------------------------------


def c_(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{rules.SPACE_CLASS_SQL}]+', ' ', 'g'), ' ')"


def key_(x: str) -> str:
    zero = r"[\x{200B}-\x{200D}\x{FEFF}]"
    return f"lower({c_(f'''regexp_replace(coalesce({x}, ''), '{zero}', '', 'g')''')})"


def role_(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    return f"CASE WHEN regexp_matches({letters}, '{'|'.join(rules.USER_WORDS)}') THEN 'user' WHEN regexp_matches({letters}, '{'|'.join(rules.ASSISTANT_WORDS)}') THEN 'assistant' ELSE '' END"


def escape_(x: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def strip_title_(x: str) -> str:
    s = rules.SPACE_CLASS_SQL
    cut = f"regexp_replace(coalesce({x}, ''), '(?i)[{s}]*\\|[{s}]*(Shared )?(ChatGPT|Claude|Gemini|Grok|Qwen).*$', '')"
    return f"regexp_replace(regexp_replace({cut}, '(?i)^Check out this chat$', ''), '^[{s}]+|[{s}]+$', '', 'g')"


def md5(x: Column | str) -> Column:
    return F.md5(x)


def pick(number: Column, values: list[str | None]) -> Column:
    found = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        found = F.when(number == i, v).otherwise(found)
    return found


def pick_(number: str, values: list[str | None]) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {number} = {i} THEN {lit(v)}" for i, v in enumerate(values[:-1])) + f" ELSE {lit(values[-1])} END"


# -- text functions ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({c_('text')}) AS body, length({c_('text')}) AS n FROM documents")
def text_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", md5(text.collapse("text")).alias("body"), F.length(text.collapse("text")).cast("long").alias("n"))


#: Beginnings that composition changes, and what it makes of them.
WIDE = ["ﬁve ＡＢ①", "e\u0301t\u00e9 Ⅳ", "ｶﾞ½", "", None]
COMPOSED = ["five AB1", "\u00e9t\u00e9 IV", "ガ1⁄2", "", ""]


@query(f"SELECT doc_id, md5({key_('text')}) AS key, md5({key_(pick_('doc_id % 5', COMPOSED) + " || ' ' || coalesce(text, '')")}) AS composed FROM documents")
def dedupe_key(spark, sf_dir):
    wide = F.concat(F.coalesce(pick(F.col("doc_id") % 5, WIDE), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", md5(text.dedupe_key("text")).alias("key"), md5(text.dedupe_key(wide)).alias("composed"))


@query(f"SELECT min(doc_id) AS doc_id, md5({key_('text')}) AS key FROM documents GROUP BY md5({key_('text')})")
def dedupe_first(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", md5(text.dedupe_key("text")).alias("key"))
    return messages.first_wins(keyed, ["key"], ["doc_id"])


ROLES = ["AI_Model", "system", "assistant-user", "focus errand", "Bot 1", "", None]


@query(f"WITH r AS (SELECT conv_id, turn, coalesce({pick_('(conv_id + turn) % 9', ROLES + ['x'])}, role) AS given, role FROM conversations) SELECT conv_id, turn, {role_('given')} AS kind, {role_('role')} AS own FROM r")
def role_normalize(spark, sf_dir):
    given = F.coalesce(pick((F.col("conv_id") + F.col("turn")) % 9, ROLES + ["x"]), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_role(given).alias("kind"), text.normalize_role("role").alias("own"))


@query(f"SELECT page_id, md5({escape_('html')}) AS body FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", md5(text.escape_html("html")).alias("body"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS spaced, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS joined, md5(replace(html, '<', '&lt;')) AS title, md5(replace(html, '\"', '&quot;')) AS attribute FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", md5(text.strip_tags("html")).alias("spaced"), md5(text.strip_tags("html", "")).alias("joined"), md5(text.escape_title("html")).alias("title"), md5(text.escape_attribute("html")).alias("attribute"))


TITLES = ["Plan | Shared ChatGPT x", "Check out this chat", " One | Two ", "A|grok", "", None, "check OUT this chat", "Long title | Claude | Qwen"]


@query(f"SELECT page_id, {strip_title_('t')} AS title FROM (SELECT page_id, {pick_('page_id % 8', TITLES)} AS t FROM pages)")
def title_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_title(pick(F.col("page_id") % 8, TITLES)).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'May 5, 2025' ELSE strftime(DATE '2024-02-29', '%A, %B %-d, %Y') END AS label FROM pages")
def date_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.date_label(pick(F.col("page_id") % 3, [" May 5,\n2025 ", " \t", None]), "2024-02-29").alias("label"))


PHRASES = ["Sign in now", "signing in", "privacy policy", " New  chat about", "Designed for mobile devices", "report", ""]


def _prefix_sql(x: str, phrases) -> str:
    v = f"lower({c_(x)})"
    return f"({v} = '' OR " + " OR ".join(f"{v} = '{p}' OR starts_with({v}, '{p} ')" for p in phrases) + ")"


@query(f"WITH d AS (SELECT doc_id, coalesce({pick_('doc_id % 8', PHRASES + [None])}, text) AS v FROM documents) SELECT doc_id, {_prefix_sql('v', rules.NOISE_PREFIXES)} AS common, {_prefix_sql('v', rules.NOISE_PREFIXES + rules.NOISE_PREFIXES_QWEN)} AS qwen FROM d")
def noise_exact_prefix(spark, sf_dir):
    value = F.coalesce(pick(F.col("doc_id") % 8, PHRASES + [None]), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.noise_prefix(value).alias("common"), text.noise_prefix(value, qwen=True).alias("qwen"))


def _part_sql(x: str, provider: str) -> str:
    v = f"lower({c_(x)})"
    return f"({v} = '' OR " + " OR ".join(f"contains({v}, '{p}')" for p in rules.NOISE_PARTS[provider]) + ")"


PARTS = ["A reporter", "Claude can make  mistakes", "Terms of Use", "we Sign in", "Open in CLAUDE", ""]


@query(f"WITH d AS (SELECT doc_id, {pick_('doc_id % 7', PARTS + [''])} || ' ' || text AS v FROM documents) SELECT doc_id, " + ", ".join(f"{_part_sql('v', p)} AS {p}" for p in rules.NOISE_PARTS) + " FROM d")
def noise_contains(spark, sf_dir):
    value = F.concat(pick(F.col("doc_id") % 7, PARTS + [""]), F.lit(" "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(text.noise_part(value, p).alias(p) for p in rules.NOISE_PARTS))


SHORT = ["ok", "sixteen letters.", "seventeen letters", "two\nlines", "", "\r", "é" * 16]


@query(f"""WITH w AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, {pick_('(conv_id + turn) % 7', SHORT)} FROM conversations)
SELECT conv_id, turn, length(coalesce(text, '')) <= 16 AND NOT regexp_matches(coalesce(text, ''), '[\\n\\r]') AS small FROM w""")
def small_bubble(spark, sf_dir):
    whole = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    short = whole.select("conv_id", (F.col("turn") + 1000).alias("turn"), pick((F.col("conv_id") + F.col("turn")) % 7, SHORT).alias("text"))
    return whole.unionByName(short).select("conv_id", "turn", text.small_bubble("text").alias("small"))


# -- routing -----------------------------------------------------------------------------------------

LINKS = [
    "https://claude.ai/share/abc", "https://GROK.com/share/x/", "https://gemini.google.com:8443/share/x", "https://chat.qwen.ai/s/x_1-y",
    "https://chat.qwen.ai/share/x", "https://chatgpt.com/share/e/x", "https://www.chatgpt.com/share/x", "http://claude.ai/share/abc",
    "https://g.co/gemini/share/x", "nope", "https://chatgpt.com/share/A-b_9?q=1#f", "https://claude.ai/SHARE/x",
]
_LINK = pick_("(conv_id + turn) % 12", LINKS)
_PARTS = f"""WITH c AS (SELECT conv_id, turn, {_LINK} AS url FROM conversations),
p AS (SELECT conv_id, turn, url, lower(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '')) AS scheme,
    lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '')) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM c),
h AS (SELECT *, CASE {' '.join(f"WHEN host = '{h}' THEN '{p}'" for h, p in rules.HOSTS.items())} ELSE 'unknown' END AS provider FROM p)"""


def _links(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pick((F.col("conv_id") + F.col("turn")) % 12, LINKS).alias("url"))


@query(f"""{_PARTS}, e AS (SELECT conv_id, turn, url, provider, CASE WHEN scheme IS NULL OR host IS NULL THEN '{admission.BAD_URL}'
    WHEN host = 'g.co' AND contains(lower(path), '/gemini/share/') THEN '{admission.SHORT_LINK}'
    WHEN scheme <> 'https' OR provider = 'unknown' OR NOT CASE WHEN provider = 'qwen' THEN regexp_matches(path, '(?i)^/s/[A-Za-z0-9_-]+/?$') ELSE regexp_matches(path, '(?i)^/share/[A-Za-z0-9_-]+/?$') END THEN '{admission.UNSUPPORTED}' END AS error FROM h)
SELECT conv_id, turn, url, provider, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error FROM e""")
def url_admission(spark, sf_dir):
    return admission.admit(_links(spark, sf_dir)).select("conv_id", "turn", "url", "provider", "status", "error")


@query(f"{_PARTS} SELECT provider, count(*) AS n FROM h GROUP BY provider")
def host_provider(spark, sf_dir):
    return admission.admit(_links(spark, sf_dir)).groupBy("provider").agg(F.count("*").alias("n"))


@query(
    f"{_PARTS} SELECT url, 400 AS code, count(*) AS n FROM h WHERE NOT (scheme IS NOT NULL AND host IS NOT NULL AND host <> 'g.co' AND scheme = 'https' AND provider <> 'unknown' AND "
    "CASE WHEN provider = 'qwen' THEN regexp_matches(path, '(?i)^/s/[A-Za-z0-9_-]+/?$') ELSE regexp_matches(path, '(?i)^/share/[A-Za-z0-9_-]+/?$') END) GROUP BY url"
    .replace("NOT (scheme", "NOT coalesce(scheme").replace("END) GROUP", "END, false) GROUP")
)
def error_sink(spark, sf_dir):
    return admission.rejected(admission.admit(_links(spark, sf_dir))).groupBy("url", "code").agg(F.count("*").alias("n"))


MARKS = ["share-viewer data-message-author-role", "Qwen Studio", "cdn.grok.com", "conversation-turn-1", "data-test-render", ""]
SOURCES = ["https://x.test/?r=grok.com", "", "", "", "", "", "", "https://CHATGPT.com/x"]


def _detect_sql(html: str, url: str) -> str:
    arms = [f"WHEN {' OR '.join(f'''contains(lower({value}), '{m}')''' for m in marks)} THEN '{p}'" for value, known in ((url, rules.URL_MARKERS), (html, rules.HTML_MARKERS)) for p, marks in known]
    return f"CASE {' '.join(arms)} ELSE 'claude' END"


@query(f"WITH p AS (SELECT page_id, left(CASE WHEN page_id % 5 = 4 THEN repeat('y', 60000) ELSE '' END || {pick_('page_id % 6', MARKS)} || html, 60000) AS h, {pick_('page_id % 8', SOURCES)} AS u FROM pages) SELECT page_id, {_detect_sql('h', 'u')} AS provider FROM p")
def provider_detect(spark, sf_dir):
    far = F.when(F.col("page_id") % 5 == 4, F.repeat(F.lit("y"), F.lit(60000))).otherwise(F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", text.detect_provider(F.concat(far, pick(F.col("page_id") % 6, MARKS), F.col("html")), pick(F.col("page_id") % 8, SOURCES)).alias("provider"))


@query(f"SELECT page_id, CASE WHEN contains(h, 'Just a moment...') OR contains(h, 'Cloudflare') THEN '{admission.BLOCKED}' END AS error FROM (SELECT page_id, {pick_('page_id % 4', ['Just a moment...', 'about Cloudflare', 'cloudflare', ''])} || html AS h FROM pages)")
def blocked_pages(spark, sf_dir):
    html = F.concat(pick(F.col("page_id") % 4, ["Just a moment...", "about Cloudflare", "cloudflare", ""]), F.col("html"))
    return admission.guard_blocked(table(spark, sf_dir, "pages").select("page_id", html.alias("html"))).select("page_id", "error")


COLLECTED = ["<p DATA-TURN='x'>", "<i class=share-layout-messages>", "nothing", None]
KINDS = ["chatgpt", "qwen", "grok"]


@query(f"""WITH p AS (SELECT page_id, html, {pick_('page_id % 4', COLLECTED)} AS got, {pick_('page_id % 3', KINDS)} AS provider FROM pages)
SELECT page_id, md5(CASE WHEN provider = 'chatgpt' AND regexp_matches(coalesce(got, ''), '(?i)data-message-author-role|conversation-turn-|data-turn=') OR provider = 'qwen' AND regexp_matches(coalesce(got, ''), '(?i)share-layout-messages|qwen-chat-message') THEN got ELSE html END) AS body FROM p""")
def collected_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html", pick(F.col("page_id") % 4, COLLECTED).alias("got"), pick(F.col("page_id") % 3, KINDS).alias("provider"))
    return p.select("page_id", md5(admission.collected_or_whole("got", "html", "provider")).alias("body"))


_SLOTS = "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) AS n FROM events)"


@query(f"{_SLOTS} SELECT event_id, n <= 1 AS admitted FROM r")
def rate_limit(spark, sf_dir):
    return admission.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=1).select("event_id", "admitted")


# -- messages ------------------------------------------------------------------------------------------


def _rows(spark, sf_dir) -> DataFrame:
    """Conversations as messages, each there twice, the second time 1,000 positions later."""
    once = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), text.normalize_role("role").alias("role"), "text")
    return once.unionByName(once.withColumn("pos", F.col("pos") + 1000)).filter("role <> ''")


_MESSAGES = f"""WITH o AS (SELECT conv_id, turn AS pos, {role_('role')} AS role, text FROM conversations),
rows AS (SELECT * FROM o WHERE role <> '' UNION ALL SELECT conv_id, pos + 1000, role, text FROM o WHERE role <> '')"""
_DEDUPED = f"""{_MESSAGES}, deduped AS (SELECT * FROM rows WHERE {key_('text')} <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, role, md5({key_('text')}) ORDER BY pos) = 1)"""


_FIRST = "arg_min(text, CASE WHEN role = 'user' THEN pos ELSE pos + 1000000 END)"
_TITLED = f"CASE WHEN length({_FIRST}) > 78 THEN left({_FIRST}, 75) || '...' ELSE {_FIRST} END"
@query(f"""{_DEDUPED} SELECT conv_id, count(*) AS n_messages, md5(string_agg(pos || role || text, chr(10) ORDER BY pos)) AS body,
    {_TITLED} AS title FROM deduped GROUP BY conv_id""")
def conversation_assemble(spark, sf_dir):
    made = messages.assemble_conversations(messages.dedupe_messages(_rows(spark, sf_dir)))
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["pos"].cast("string"), m["role"], m["text"])), "\n")
    return made.select("conv_id", "n_messages", "title", md5(body).alias("body"))


#: Every third conversation is opened by a short question before its first turn.
_OPENED = f"""{_MESSAGES}, opened AS (SELECT * FROM rows UNION ALL SELECT DISTINCT conv_id, -1, 'user', 'Question ' || conv_id FROM rows WHERE conv_id % 3 = 0)"""


@query(f"""{_OPENED}, f AS (SELECT conv_id, {_FIRST} AS f FROM opened GROUP BY conv_id),
t AS (SELECT conv_id, f, {strip_title_(pick_('conv_id % 8', TITLES))} AS t FROM f)
SELECT conv_id, CASE WHEN t <> '' THEN t WHEN length(f) > 78 THEN left(f, 75) || '...' ELSE f END AS title FROM t""")
def conversation_title(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    opening = rows.filter("conv_id % 3 = 0").select("conv_id").distinct().select("conv_id", F.lit(-1).alias("pos"), F.lit("user").alias("role"), F.concat(F.lit("Question "), F.col("conv_id").cast("string")).alias("text"))
    return messages.assemble_conversations(rows.unionByName(opening), title=pick(F.col("conv_id") % 8, TITLES)).select("conv_id", "title")


_PRIMARY = "(role = 'user' OR conv_id % 2 = 0) AND pos < 1000"
_MERGE = f"""{_MESSAGES}, p AS (SELECT * FROM rows WHERE {_PRIMARY}), f AS (SELECT * FROM rows WHERE pos >= 1000 OR role = 'assistant'),
whole AS (SELECT conv_id FROM p GROUP BY conv_id HAVING count(*) >= 2 AND bool_or(role = 'user') AND bool_or(role = 'assistant')),
u AS (SELECT *, 0 AS source FROM p WHERE conv_id NOT IN (SELECT conv_id FROM whole) UNION ALL SELECT *, 1 FROM f WHERE conv_id NOT IN (SELECT conv_id FROM whole)),
m AS (SELECT *, 0 AS source FROM p WHERE conv_id IN (SELECT conv_id FROM whole) UNION ALL
    SELECT * FROM u WHERE {key_('text')} <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, role, md5({key_('text')}) ORDER BY source, pos) = 1)
SELECT conv_id, pos, role, source FROM m"""


@query(_MERGE)
def merge_sources(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return messages.merge_sources(rows.filter(_PRIMARY), rows.filter("pos >= 1000 or role = 'assistant'")).select("conv_id", "pos", "role", "source")


@query(f"{_MESSAGES}, p AS (SELECT * FROM rows WHERE pos < 1000 AND conv_id % 3 = 0) SELECT conv_id, pos, role FROM p UNION ALL SELECT conv_id, pos, role FROM rows WHERE pos >= 1000 AND conv_id NOT IN (SELECT conv_id FROM p)")
def priority_fallback(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return messages.prefer(rows.filter("pos < 1000 and conv_id % 3 = 0"), rows.filter("pos >= 1000")).select("conv_id", "pos", "role")


@query(f"""{_MESSAGES}, p AS (SELECT * FROM rows WHERE pos < conv_id % 4) SELECT conv_id, pos, 1 AS stage FROM p UNION ALL
SELECT conv_id, pos, 2 FROM rows WHERE pos >= 1000 AND conv_id NOT IN (SELECT conv_id FROM p GROUP BY conv_id HAVING count(*) >= 2)""")
def widened_scan(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return messages.widen(rows.filter(F.col("pos") < F.col("conv_id") % 4), rows.filter("pos >= 1000")).select("conv_id", "pos", "stage")


_CAPTURE = f"""{_MESSAGES}, k AS (SELECT *, coalesce(nullif(CASE WHEN conv_id % 4 = 0 THEN 't' || pos % 1000 ELSE '' END, ''), nullif(CASE WHEN conv_id % 4 = 1 THEN 'c' || pos % 3 END, ''),
    role || ':' || left({c_('text')}, 180)) AS key FROM rows)"""


@query(f"{_CAPTURE} SELECT conv_id, min(pos) AS pos, md5(key) AS key FROM k GROUP BY conv_id, md5(key)")
def first_wins_capture(spark, sf_dir):
    pos = F.col("pos")
    turn_id = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("t"), (pos % 1000).cast("string"))).otherwise(F.lit(""))
    container = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("c"), (pos % 3).cast("string")))
    keyed = _rows(spark, sf_dir).withColumn("key", md5(text.turn_key(turn_id, container, F.lit(None).cast("string"), F.col("role"), F.col("text"))))
    return messages.first_wins(keyed, ["conv_id", "key"], ["pos"]).select("conv_id", "pos", "key")


_LINES = f"lines AS (SELECT doc_id, text, line, pos FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"WITH {_LINES} SELECT doc_id, pos, length({c_('line')}) AS n FROM lines WHERE {c_('line')} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length({c_('line')}) DESC, pos) = 1")
def best_longest(spark, sf_dir):
    return messages.best_longest(_lines(spark, sf_dir).drop("text"), "doc_id", "line", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), F.length(text.collapse("line")).cast("long").alias("n"))


@query(f"WITH {_LINES} SELECT doc_id, pos FROM lines WHERE length({c_('line')}) >= 1 AND length({c_('line')}) >= floor(length(text) * 0.55::DOUBLE) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length({c_('line')}), pos) = 1")
def best_shortest_55pct(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("size", F.length("text")).drop("text")
    return messages.best_shortest(lines, "doc_id", "line", "pos", F.col("size")).select("doc_id", F.col("pos").cast("long").alias("pos"))


@query(f"""{_MESSAGES}, k AS (SELECT conv_id, role, conv_id * 65536 + pos AS id, {key_('text')} AS key FROM rows WHERE pos < 1000),
r AS (SELECT * FROM k UNION ALL SELECT conv_id, role, id + 1000, left(key, 60) FROM k)
SELECT x.conv_id, x.role, x.id AS a, y.id AS b FROM r x JOIN r y ON x.conv_id = y.conv_id AND x.role = y.role AND x.id <> y.id AND length(x.key) > 40 AND length(y.key) > 40 AND contains(y.key, x.key)""")
def near_dup_pairs(spark, sf_dir):
    """Messages of one speaker in a conversation of which one holds the other; each is there in full and cut."""
    return messages.near_duplicate_pairs(_full_and_cut(spark, sf_dir), ["conv_id", "role"], "id", "key")


def _full_and_cut(spark, sf_dir) -> DataFrame:
    ident = F.shiftleft("conv_id", 16) + F.col("pos")
    keyed = _rows(spark, sf_dir).filter("pos < 1000").select("conv_id", "role", ident.alias("id"), text.dedupe_key("text").alias("key"))
    return keyed.unionByName(keyed.select("conv_id", "role", (F.col("id") + 1000).alias("id"), F.substring("key", 1, 60).alias("key")))


@query(f"""{_MESSAGES.replace('WITH ', 'WITH RECURSIVE ', 1)}, k AS (SELECT conv_id, role, conv_id * 65536 + pos AS id, {key_('text')} AS key FROM rows WHERE pos < 1000),
r AS (SELECT * FROM k UNION ALL SELECT conv_id, role, id + 1000, left(key, 60) FROM k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY id) AS n, count(*) OVER (PARTITION BY conv_id, role) AS size FROM r),
fold AS (SELECT conv_id, role, 1 AS n, [{{'id': id, 'key': key}}] AS kept FROM ranked WHERE n = 1
    UNION ALL SELECT f.conv_id, f.role, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda s: s.key = o.key OR (length(s.key) > 40 AND length(o.key) > 40 AND (contains(s.key, o.key) OR contains(o.key, s.key))))) > 0
        THEN f.kept ELSE list_append(f.kept, {{'id': o.id, 'key': o.key}}) END FROM fold f JOIN ranked o ON o.conv_id = f.conv_id AND o.role = f.role AND o.n = f.n + 1),
last AS (SELECT f.* FROM fold f JOIN ranked o USING (conv_id, role, n) WHERE o.n = o.size)
SELECT conv_id, role, unnest(list_transform(kept, lambda s: s.id)) AS id FROM last""")
def near_dup_survivors(spark, sf_dir):
    """Of one speaker's messages in a conversation those that stay in an ordered fold of near copies."""
    rows = _full_and_cut(spark, sf_dir)
    pairs = messages.near_duplicate_pairs(rows, ["conv_id", "role"], "id", "key")
    return candidates.near_duplicate_survivors(pairs, rows, ["conv_id", "role"], "id", "key")


@query(f"{_MESSAGES} SELECT conv_id, md5('<!doctype html><html><head><title>' || 'T <'.replace('<', '&lt;') || '</title><link rel=\"canonical\" href=\"' || 'u&quot;' || conv_id || '\"></head><body><main>' || string_agg('<p>' || text || '</p>', chr(10) ORDER BY pos) || '</main></body></html>') AS body FROM rows WHERE pos < 1000 GROUP BY conv_id".replace("'T <'.replace('<', '&lt;')", "'T &lt;'"))
def synthetic_document(spark, sf_dir):
    rows = _rows(spark, sf_dir).filter("pos < 1000").select("conv_id", "pos", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("html"), F.lit("T <").alias("title"), F.concat(F.lit('u"'), F.col("conv_id").cast("string")).alias("link"))
    return messages.synthetic_documents(rows, "conv_id", "pos", "html", "title", "link").select("conv_id", md5("html").alias("body"))


# -- rendering -----------------------------------------------------------------------------------------


def _conversations(spark, sf_dir):
    made = messages.assemble_conversations(_rows(spark, sf_dir).filter("pos < 1000"))
    safe = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit("<p>"), text.escape_html(m["text"]), F.lit("</p>")).alias("html"), m["text"].alias("text"), F.when(m["pos"] % 3 == 1, "Thought for 3s").otherwise(F.lit("")).alias("thought")))
    return made.withColumns({"messages": safe, "provider": F.lit("grok"), "date": F.lit("May 5, 2025"), "url": F.lit("")})


_RENDERED = f"""{_MESSAGES}, parts AS (SELECT conv_id, pos, role, text, CASE WHEN role = 'user' THEN '<div class="message user"><div class="bubble' || CASE WHEN length(text) <= 16 AND NOT regexp_matches(text, '[\\n\\r]') THEN ' small' ELSE '' END || '">' || {escape_('text')} || '</div></div>'
    ELSE '<div class="message assistant"><div class="copy">' || CASE WHEN pos % 3 = 1 THEN '<div class="thought"><span>Thought for 3s</span></div>' ELSE '' END || '<p>' || {escape_('text')} || '</p></div></div>' END AS part FROM rows WHERE pos < 1000),
docs AS (SELECT conv_id, {_TITLED} AS title, string_agg(part, chr(10) ORDER BY pos) AS body FROM parts GROUP BY conv_id),
full_docs AS (SELECT conv_id, title, body, '<div class="paper"><header><div class="title">' || {escape_('title')} || '</div><div class="subtitle">May 5, 2025 · GROK</div></header><div class="chat">' || body || '</div></div>' AS doc FROM docs)"""


@query(f"{_RENDERED} SELECT conv_id, md5(body) AS body FROM docs")
def render_messages(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", md5(render.render_messages("messages")).alias("body"))


@query(f"{_RENDERED} SELECT conv_id, md5(doc) AS template, md5('<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>' || {escape_('title')} || '</title>{render.render_styles()}</head><body>' || doc || '</body></html>') AS page FROM full_docs")
def render_document(spark, sf_dir):
    made = render.render(_conversations(spark, sf_dir)).withColumnRenamed("document", "template")
    return render.render(made, standalone=True).select("conv_id", md5("template").alias("template"), md5("document").alias("page"))


@query(f"""{_MESSAGES}, m AS (SELECT conv_id, '[' || string_agg('{{"role":"' || role || '","text":' || to_json(text) || '}}', ',' ORDER BY pos) || ']' AS j FROM rows WHERE pos < 1000 GROUP BY conv_id) SELECT conv_id, md5(j) AS body FROM m""")
def json_sink(spark, sf_dir):
    made = messages.assemble_conversations(_rows(spark, sf_dir).filter("pos < 1000"))
    return made.select("conv_id", md5(F.to_json(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))))).alias("body"))


# -- guides --------------------------------------------------------------------------------------------


def _guides(spark, sf_dir):
    name = lambda c: F.concat(F.lit("g"), c.cast("string"))
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("position"), name(i).alias("slug"), F.concat(F.lit(" Guide "), i.cast("string"), F.lit(" | Site | x")).alias("title"), F.array(name(i + 7), name(i + 1), F.lit("none"), name(i + 7)).alias("related_slugs"), F.array(F.struct(F.concat(F.lit('Is "'), i.cast("string"), F.lit('" ok?')).alias("q"), F.lit("Yes").alias("a"))).alias("faqs"))


def _repeated(spark, sf_dir):
    """The guides, and others under the same slugs at later positions, whose titles sort before theirs."""
    known = _guides(spark, sf_dir)
    again = known.withColumns({"position": F.col("position") + 10_000_000, "title": F.concat(F.lit(" Again"), F.col("title"))})
    return again.unionByName(known)


@query("""WITH w AS (SELECT doc_id, unnest([doc_id + 7, doc_id + 1, -1, doc_id + 7]) AS r, unnest([0, 1, 2, 3]) AS pos FROM documents), n AS (SELECT unnest([1, 2]))
SELECT 'g' || w.doc_id AS slug, pos::BIGINT AS pos, 'g' || d.doc_id AS related_slug, 'Guide ' || d.doc_id AS related_title FROM w JOIN documents d ON d.doc_id = w.r CROSS JOIN n""")
def related_join(spark, sf_dir):
    return guides.related(_repeated(spark, sf_dir))


@query("SELECT doc_id AS position, 'Guide ' || doc_id AS title FROM documents WHERE doc_id = 17")
def guide_lookup(spark, sf_dir):
    return guides.guide(_repeated(spark, sf_dir), "g17").select("position", guides.short_title("title").alias("title"))


@query("""SELECT doc_id AS position, '{"@type":"ListItem","position":' || doc_id || ',"url":"https://x.test/tools/g' || doc_id || '","name":"Guide ' || doc_id || '"}' AS item,
'{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Is \\"' || doc_id || '\\" ok?","acceptedAnswer":{"@type":"Answer","text":"Yes"}}]}' AS faq,
'{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"S","item":"https://x.test/"},{"@type":"ListItem","position":2,"name":"Tools","item":"https://x.test/tools"},{"@type":"ListItem","position":3,"name":"Guide ' || doc_id || '","item":"https://x.test/tools/g' || doc_id || '"}]}' AS crumbs, count(*) OVER () AS n FROM documents""")
def structured_data(spark, sf_dir):
    g = _guides(spark, sf_dir)
    total = g.agg(F.count("*").alias("n"))  # one row
    made = g.select("position", guides.item_list(g, "https://x.test/tools/").alias("item"), guides.faq_page("faqs").alias("faq"), guides.breadcrumbs("https://x.test/", "S", guides.short_title("title"), F.col("slug")).alias("crumbs"))
    return made.join(F.broadcast(total))


# -- pages ---------------------------------------------------------------------------------------------


@query()
def page_dom_text(spark, sf_dir):
    """Collapsed text of the stored pages' trees, and how many of their elements are noise."""
    return share.dom_summary(table(spark, sf_dir, "pages"))


@query()
def sanitize_pages(spark, sf_dir):
    made = table(spark, sf_dir, "pages").select("page_id", sanitize_html(F.col("html"), F.lit("")).alias("html"))
    return made.select("page_id", F.length("html").alias("n_chars"), md5("html").alias("body"))


@query("SELECT page_id, 'claude' AS provider, 0::BIGINT AS n_messages, 'No conversation messages were found in this HTML.' AS error FROM pages")
def parse_stored_pages(spark, sf_dir):
    """The stored pages come from no provider; all of them land in the quarantine."""
    made = providers.assemble(providers.parse_pages(table(spark, sf_dir, "pages")), "2024-02-29")
    return made.select("page_id", "provider", F.size("messages").cast("long").alias("n_messages"), "error")


def _parse(name: str):
    def run(spark, sf_dir):
        pages = share.provider_pages(table(spark, sf_dir, "conversations"), name)
        form = share.FORMS[name]
        made = providers.assemble(providers.parse_pages(pages, form.provider if form.canonical else None), "2024-02-29")
        body = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["text"], m["html"], m["thought"])), "\n")
        return made.select("page_id", "provider", "title", "date", "url", F.size("messages").cast("long").alias("n_messages"), md5(body).alias("body"))

    return run


def _relational(name: str):
    def run(spark, sf_dir):
        pages = share.provider_pages(table(spark, sf_dir, "conversations"), name)
        made = providers.assemble(candidates.parse_pages(pages), "2024-02-29")
        body = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["text"], m["html"], m["thought"])), "\n")
        return made.select("page_id", "provider", "title", "date", "url", F.size("messages").cast("long").alias("n_messages"), md5(body).alias("body"))

    return run


for _name in (n for n, form in share.FORMS.items() if form.provider == "claude"):
    QUERIES[f"parse_{_name}_relational"] = _relational(_name)
    ORACLE_SQL[f"parse_{_name}_relational"] = share.provider_sql(_name, c_, key_)


#: Elements of a page outside of its turns, of which the navigation is noise; and of each turn.
_TURNS = "WITH t AS (SELECT conv_id AS page_id, 2 * count(*) FILTER (role = 'user') AS u, 2 * count(*) FILTER (role = 'assistant') AS a FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"


@query(f"{_TURNS} SELECT page_id, 5 + page_id % 2 + 3 * u + 5 * a AS n_nodes, 1 + a AS n_noise, 4 + page_id % 2 + 3 * u + 4 * a AS n_clean, u + a AS n_content FROM t")
def noise_by_interval(spark, sf_dir):
    """Elements of share pages, those inside of noise, those outside, and turns with content below."""
    pages = share.provider_pages(table(spark, sf_dir, "conversations"), "chatgpt")
    rows = nodes.node_table(pages)
    marked = nodes.inside(rows, "noise", nodes.matching(rules.NOISE_NODES))
    marked = nodes.first_below(marked, "content", nodes.matching(".whitespace-pre-wrap, .markdown"))
    return marked.groupBy("page_id").agg(
        F.count("*").alias("n_nodes"), F.count_if("noise").alias("n_noise"), F.count_if(~F.col("noise")).alias("n_clean"),
        F.count_if(nodes.matching("section[data-turn]") & F.col("content").isNotNull()).alias("n_content"),
    )


@query(f"{_TURNS}, r AS (SELECT page_id, unnest(['user', 'assistant', '']) AS role, unnest([2 * u, 3 * a, 6 + page_id % 2]) AS n FROM t) SELECT page_id, role, n::BIGINT AS n FROM r WHERE n > 0")
def role_by_ancestor(spark, sf_dir):
    """Elements of share pages by the role that they or what stands above them tell."""
    pages = share.provider_pages(table(spark, sf_dir, "conversations"), "qwen_generic")
    return nodes.role_by_ancestor(nodes.node_table(pages), providers._HINTS).groupBy("page_id", "role").agg(F.count("*").alias("n"))


@query()
def node_table(spark, sf_dir):
    """The stored pages' trees by depth of noise: elements, those inside of noise, the deepest run of tags."""
    rows = nodes.inside(nodes.node_table(table(spark, sf_dir, "pages")), "noise", nodes.matching(rules.NOISE_NODES))
    shape = md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nid", "parent", "last", "tag"))), lambda n: F.concat_ws("|", n["nid"], n["parent"], n["last"], n["tag"])), ","))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.count_if("noise").alias("n_noise"), shape.alias("shape"))


@query(share.provider_sql("chatgpt", c_, key_, "page_id, provider, n_messages, body"))
def lateral_messages(spark, sf_dir):
    """Share pages' messages by the table function, in SQL."""
    table_functions.register(spark)
    pages = share.provider_pages(table(spark, sf_dir, "conversations"), "chatgpt")
    return spark.sql("""
        SELECT page_id, provider, count(*) AS n_messages, md5(array_join(transform(array_sort(collect_list(struct(pos, concat_ws('|', role, text, m.html, thought) AS line))), x -> x.line), '\n')) AS body
        FROM {pages} p, LATERAL parse_messages(p.html, p.url) m GROUP BY page_id, provider""", pages=pages)  # fmt: skip


@query(f"{_TURNS} SELECT page_id, tag, n::BIGINT AS n FROM (SELECT page_id, unnest(['html', 'head', 'body', 'nav', 'main', 'title', 'section', 'button', 'div', 'p']) AS tag, unnest([1, 1, 1, 1, 1, page_id % 2, u + a, a, 2 * u + 2 * a, a]) AS n FROM t) WHERE n > 0")
def lateral_nodes(spark, sf_dir):
    """Share pages' elements by tag, by the table function, in SQL."""
    table_functions.register(spark)
    pages = share.provider_pages(table(spark, sf_dir, "conversations"), "chatgpt")
    return spark.sql("SELECT page_id, tag, count(*) AS n FROM {pages} p, LATERAL page_nodes(p.html) GROUP BY page_id, tag", pages=pages)


#: A turn's text in the walked JSON: long ones stand at both sides of the longest that counts.
_LONG = f"CASE WHEN turn = 1 AND conv_id % 40 = 0 THEN rpad(coalesce(text, ''), {rules.MAX_TEXT + 1}, 'x') WHEN turn = 1 AND conv_id % 40 = 20 THEN rpad(coalesce(text, ''), {rules.MAX_TEXT}, 'x') ELSE coalesce(text, '') END"
_NOISY = " OR ".join(f"v = '{p}' OR starts_with(v, '{p} ')" for p in rules.NOISE_PREFIXES + rules.NOISE_PREFIXES_QWEN)
_TRIMMED = f"regexp_replace(replace(text, chr(0), ''), '^[{rules.SPACE_CLASS_SQL}]+|[{rules.SPACE_CLASS_SQL}]+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_LONG} AS text FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4),
m AS (SELECT conv_id, role, {_TRIMMED} AS text, CASE WHEN turn % 2 = 0 THEN -turn ELSE turn END AS pos, lower({c_('text')}) AS v, {key_('text')} AS k FROM t),
kept AS (SELECT * FROM m WHERE v <> '' AND length(text) <= {rules.MAX_TEXT} AND NOT ({_NOISY}) QUALIFY row_number() OVER (PARTITION BY conv_id, role, md5(k) ORDER BY pos) = 1)
SELECT conv_id AS page_id, count(*) AS n_messages, md5(string_agg(role || '|' || text, chr(10) ORDER BY pos)) AS body FROM kept GROUP BY conv_id""")
def json_walk(spark, sf_dir):
    """Conversations as an object in scripts, walked: keys of even turns are integers that fall, so they
    come first and turned round; each fifth turn is nested deeper than counts, the one before just not."""
    scripts = share.walked_scripts(table(spark, sf_dir, "conversations"), _LONG)
    found = embedded.json_messages(scripts)
    line = F.concat_ws("|", "role", "text")
    made = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("script", "path", line.alias("line")))).alias("lines"))
    return made.select("page_id", F.size("lines").cast("long").alias("n_messages"), md5(F.array_join(F.transform("lines", lambda m: m["line"]), "\n")).alias("body"))


for _name in share.FORMS:
    QUERIES[f"parse_{_name}"] = _parse(_name)
    ORACLE_SQL[f"parse_{_name}"] = share.provider_sql(_name, c_, key_)


_DOCUMENTS = f"""
, parts AS (SELECT page_id, pos, CASE WHEN role = 'user' THEN '<div class="message user"><div class="bubble' || CASE WHEN length(text) <= 16 AND NOT regexp_matches(text, '[\\n\\r]') THEN ' small' ELSE '' END || '">' || {escape_('text')} || '</div></div>'
    ELSE '<div class="message assistant"><div class="copy"><div class="thought"><span>' || thought || '</span></div>' || html || '</div></div>' END AS part FROM kept),
docs AS (SELECT page_id, n_messages, error, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || {escape_('title')} || '</title>{render.render_styles()}</head><body><div class="paper"><header><div class="title">' || {escape_('title')}
    || '</div><div class="subtitle">' || date || ' · CHATGPT</div></header><div class="chat">' || (SELECT string_agg(part, chr(10) ORDER BY pos) FROM parts p WHERE p.page_id = made.page_id) || '</div></div></body></html>' AS doc FROM made)"""


@query(share.provider_sql("chatgpt", c_, key_, "page_id, n_messages, error, (SELECT md5(doc) FROM docs d WHERE d.page_id = made.page_id) AS document", _DOCUMENTS))
def pages_to_documents(spark, sf_dir):
    """Links to rendered documents, end to end; pages without messages stay without a document."""
    made = _documents(spark, sf_dir)
    return made.filter("document is not null or error is not null").select("page_id", F.size("messages").cast("long").alias("n_messages"), "error", md5("document").alias("document"))


def _documents(spark, sf_dir) -> DataFrame:
    pages = share.provider_pages(table(spark, sf_dir, "conversations"), "chatgpt")
    good = admission.accepted(admission.admit(admission.guard_blocked(pages).filter("error is null").drop("error"))).drop("provider")
    return render.render(providers.assemble(providers.parse_pages(good), "2024-02-29"), standalone=True)


@query(share.provider_sql("chatgpt", c_, key_, "page_id, (SELECT md5(doc) FROM docs d WHERE d.page_id = made.page_id) AS document", _DOCUMENTS))
def document_files(spark, sf_dir):
    """Documents of share pages, written as a file each and read again."""
    return streams.document_files(spark, _documents(spark, sf_dir)).select("page_id", md5("html").alias("document"))


#: Markup with {} for a text, and what is safe of it.
SAFE = [
    ('<p onclick="x">{}</p><script>bad()</script><style>p{color:red}</style>', "<p>{}</p>"),
    ('<a class="c" href="https://x.test/?a=1" rel="nofollow">{}</a><img src="x">', '<a href="https://x.test/?a=1" target="_blank">{}</a>'),
    ('<a href="javascript:x()">{}</a><nav>Home</nav><div aria-hidden="true">no</div>', "<a>{}</a>"),
    (
        '<span class="katex"><span class="katex-mathml"><math><semantics><mi foo="1" mathvariant="bold">x</mi><annotation encoding="application/x-tex">x</annotation></semantics></math></span><span aria-hidden="true">x</span></span> {}',
        '<span class="tl-math tl-math-inline" role="math"><math xmlns="http://www.w3.org/1998/Math/MathML" display="inline"><semantics><mi mathvariant="bold">x</mi></semantics></math></span> {}',
    ),
    ('<div data-latex="a^2"><b>f</b></div><p>{}</p>', '<div class="tl-math tl-math-display" role="math" data-tex="a^2">a^2</div><p>{}</p>'),
    ('<section><h2 id="x">{}</h2><div> </div><button>no</button><p></p></section>', "<h2>{}</h2>"),
    ('<ul class="l"><li>{}<li><code>b</code></ul><div class="hidden">no</div>', "<ul><li>{}</li><li><code>b</code></li></ul>"),
    (
        '<svg><path d="M0"></path></svg><math display="block"><mrow><mn>1</mn></mrow></math>{}<script type="math/tex">y</script>',
        '<div class="tl-math tl-math-display" role="math"><math display="block" xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mn>1</mn></mrow></math></div>{}',
    ),
    ('<span class="math-display" aria-label="\\frac{1}{2}"><i>half</i></span><span>{}</span><button>{}</button>', '<div class="tl-math tl-math-display" role="math" data-tex="\\frac{1}{2}">\\frac{1}{2}</div>{}'),
    ("<form>{}</form><textarea>no</textarea>", "<p>none</p>"),
]


def _made_parts(column: Column, values: list[str], number: Column) -> Column:
    found = F.lit(None).cast("string")
    for i, value in enumerate(values):
        found = F.when(number == i, F.replace(F.lit(value), F.lit("{}"), column)).otherwise(found)
    return found


_PIECE = f"replace(replace(replace(replace({c_('text')}, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT conv_id, turn, md5(trim(replace({pick_(f'(conv_id + turn) % {len(SAFE)}', [safe for _, safe in SAFE])}, '{{}}', {_PIECE}))) AS body FROM conversations""")
def sanitize_parts(spark, sf_dir):
    """Markup of turns with scripts, links, math and noise around their texts."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", _made_parts(text.escape_html(text.collapse("text")), [raw for raw, _ in SAFE], (F.col("conv_id") + F.col("turn")) % len(SAFE)).alias("html"))
    return parts.select("conv_id", "turn", md5(sanitize_html(F.col("html"), F.lit("none"))).alias("body"))


_TREE_SQL = "'THome x' || coalesce(text, '') || 'onetwoabs'"
_TREE = """<!doctype html><html><head><title>T</title></head><body><nav>Home <b>x</b></nav><p>{}<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div class="sticky">s</div></body></html>"""


@query(f"SELECT conv_id, turn, 14::BIGINT AS n_elements, 2::BIGINT AS n_noise, md5({c_(_TREE_SQL)}) AS text FROM conversations")
def dom_parts(spark, sf_dir):
    """Trees of pages made around the texts of turns, with tags that are implied."""
    rows = table(spark, sf_dir, "conversations").withColumn("page_id", F.shiftleft("conv_id", 16) + F.col("turn"))
    made = share.dom_summary(rows.select("page_id", F.replace(F.lit(_TREE), F.lit("{}"), text.escape_html("text")).alias("html")))
    return made.select(F.shiftright("page_id", 16).alias("conv_id"), (F.col("page_id") % 65536).alias("turn"), "n_elements", "n_noise", md5("text").alias("text"))


# -- captures ------------------------------------------------------------------------------------------

_TURN = '<section data-turn="user" class="t"><button>Copy</button><div class="msg-actions x">no</div><p>{}</p><span class="sr-only">no</span><i>end</i></section>'
_CLEAN = '<section data-turn="user" class="t"><p>{}</p><i>end</i></section>'


@query(f"SELECT conv_id, turn, md5(replace('{_CLEAN}', '{{}}', {_PIECE})) AS body FROM conversations")
def clean_turns(spark, sf_dir):
    """Captured turns without their interface parts."""
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(F.lit(_TURN), F.lit("{}"), text.escape_html(text.collapse("text"))).alias("html"))
    return made.select("conv_id", "turn", md5(capture.clean_turns("html")).alias("body"))


_SHARED = '<div class="share-layout-date"> May 5 </div><div class="share-layout-messages" id="m"><p>{}</p><div class="user-message-footer">no</div><span role="button">no</span><svg></svg></div>'


@query(f"""SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 THEN '' ELSE '<!doctype html><html lang="' || CASE WHEN turn % 3 = 0 THEN 'de' ELSE 'en' END || '"><head><title>A &amp; &lt;B&quot; ' || conv_id || '</title><link rel="canonical" href="https://x.test/?a=1&amp;b=' || turn
|| '"></head><body><div class="share-layout-title">A &amp; &lt;B&quot; ' || conv_id || '</div><div class="share-layout-date">May 5</div><div class="share-layout-messages" id="m"><p>' || {_PIECE} || '</p></div></body></html>' END) AS body FROM conversations""")
def share_snapshot(spark, sf_dir):
    """Snapshots of share pages: titles from the page or its head, links from the page or its address."""
    name = F.concat(F.lit("A &amp; &lt;B\" "), F.col("conv_id").cast("string"))
    link = F.concat(F.lit("https://x.test/?a=1&b="), F.col("turn").cast("string"))
    kind = F.col("turn") % 3
    shared = F.replace(F.lit(_SHARED), F.lit("{}"), text.escape_html(text.collapse("text")))
    html = (
        F.when(kind == 0, F.concat(F.lit('<html lang="de"><title>'), name, F.lit("</title><body>"), shared))
        .when(kind == 1, F.concat(F.lit("<title>other</title><link rel=canonical href='"), link, F.lit("'><p class=share-layout-title> "), name, F.lit(" </p>"), shared))
        .otherwise(F.concat(F.lit("<title>no messages</title><p>"), name))
    )
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", html.alias("html"), F.when(kind == 0, link).alias("url"))
    return made.select("conv_id", "turn", md5(capture.snapshot("html", "url")).alias("body"))


_CAPTURED = f"""WITH t AS (SELECT conv_id, turn, role, {_PIECE} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {c_('text')} <> '')
SELECT conv_id AS page_id, md5('<!doctype html><html lang="en"><head><title>Chat ' || conv_id || '</title><link rel="canonical" href="https://chatgpt.com/share/' || conv_id || '"><meta property="og:title" content="say &quot;hi&quot;"><meta property="og:description" content=""></head><body><main data-provider="chatgpt">'
|| string_agg('<section data-turn="' || role || '" data-turn-id="t' || turn || '"><p>' || text || '</p></section>', chr(10) ORDER BY turn) || '</main></body></html>') AS body FROM t GROUP BY conv_id"""


def _scrolled(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')").withColumn("text", text.collapse("text")).filter("text <> ''")
    twice = turns.withColumn("turn_", F.explode(F.array("turn", F.col("turn") + 1000)))
    part = F.concat(F.lit('<section data-turn="'), F.col("role"), F.lit('" data-turn-id="t'), F.col("turn").cast("string"), F.lit('"><p>'), text.escape_html("text"), F.lit("</p><button>Copy</button></section>"))
    made = twice.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn_").alias("at"), part.alias("part")))), lambda t: t["part"]), "").alias("turns"))
    ident = F.col("conv_id").cast("string")
    return made.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("https://chatgpt.com/share/"), ident).alias("url"), F.concat(F.lit("<title>Chat "), ident, F.lit("</title><meta property='og:title' content='say \"hi\"'>"), F.col("turns")).alias("html"))


@query(_CAPTURED)
def capture_pages(spark, sf_dir):
    """Pages read as a scrolling capture reads them: turns cleaned, the first of each kept, put together."""
    pages = _scrolled(spark, sf_dir)
    return capture.synthetic_pages(capture.captured(capture.page_turns(pages)), capture.page_heads(pages)).select("page_id", md5("html").alias("body"))


@query(_CAPTURED)
def stream_capture_pages(spark, sf_dir):
    """The same as a stream: turns come in scrambled order, in five parts and over as many micro-batches
    at least, and a page's document is made when it has gone idle."""
    pages = _scrolled(spark, sf_dir)
    turns = capture.page_turns(pages)
    key = text.turn_key("turn_id", "container_id", "test_id", "turn", "text")
    polls = turns.select("page_id", key.alias("key"), F.col("pos").cast("long").alias("pos"), "html", F.timestamp_seconds(10**8 + F.col("pos")).alias("ts"))
    return capture.with_heads(streams.captured_bodies(spark, polls).select("page_id", "body"), capture.page_heads(pages)).select("page_id", md5("html").alias("body"))


# -- readers -------------------------------------------------------------------------------------------


@query("""SELECT doc_id + 1 AS position, 'g' || doc_id AS slug, 'Guide "' || doc_id || '" | S' AS title, doc_id % 2 = 0 AS noindex, 'g' || (doc_id + 1) AS related, md5(text) AS intro FROM documents""")
def guide_files(spark, sf_dir):
    """Guides written as one file of a JSON array, and read again in their order."""
    return streams.guide_files(spark, table(spark, sf_dir, "documents"))


@query("SELECT 'https://x.test/?p=' || page_id || '&q=' || page_id % 7 AS loc, DATE '2024-01-01' + (page_id % 400)::INT AS lastmod, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'weekly' END AS changefreq, (page_id % 10) / 10.0::DOUBLE AS priority FROM pages")
def sitemap_files(spark, sf_dir):
    """Site maps written as XML, and read again."""
    return streams.sitemap_files(spark, table(spark, sf_dir, "pages"))


# -- streams -------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def stream_first_capture(spark, sf_dir):
    return streams.first_captures(spark, sf_dir)


@query(f"{_SLOTS} SELECT event_id, n <= 1 AS admitted FROM r")
def stream_rate_limit(spark, sf_dir):
    return streams.rate_limit(spark, sf_dir)


@query("""WITH p AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type || event_id % 16 AS key, 420 * (user_id % 90) AS bottom FROM events WHERE user_id IS NOT NULL),
q AS (SELECT *, 420 * least(step, user_pages) AS top, row_number() OVER (PARTITION BY page_id, key ORDER BY step) = 1 AS new FROM (SELECT *, page_id % 90 AS user_pages FROM p)),
f AS (SELECT *, NOT new AND step > 0 AND (top >= bottom - 8 OR top = lag(top) OVER (PARTITION BY page_id ORDER BY step)) AS still FROM q),
g AS (SELECT *, still AND lag(still, 1, false) OVER w AND lag(still, 2, false) OVER w AS stops FROM f WINDOW w AS (PARTITION BY page_id ORDER BY step)),
s AS (SELECT page_id, least(min(step) FILTER (stops), 72, max(step)) AS n_steps, min(step) FILTER (stops) AS third FROM g GROUP BY page_id)
SELECT page_id, n_steps, (SELECT count(*) FROM q WHERE q.page_id = s.page_id AND q.new AND q.step <= s.n_steps) AS n_turns, CASE WHEN third = n_steps THEN 'still' WHEN n_steps = 72 THEN 'steps' ELSE 'idle' END AS stopped FROM s""")
def stream_scroll_stops(spark, sf_dir):
    """Events as polls of a page a user: each brings one turn, pages are of 0 to 89 steps. Polls come in
    scrambled order, in three parts and over as many micro-batches at least."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), (F.row_number().over(order) - 1).cast("long").alias("step"), F.concat("event_type", (F.col("event_id") % 16).cast("string")).alias("key"))
    last = F.col("page_id") % 90
    polls = events.select("page_id", "step", (420 * F.least("step", last)).alias("top"), (420 * last).alias("bottom"), F.array("key").alias("keys"), F.timestamp_seconds(10**8 + F.col("step")).alias("ts"))
    return streams.scroll_stops(spark, polls)


@query(share.provider_sql("chatgpt", c_, key_, "page_id, CASE WHEN error IS NULL THEN n_messages END AS n_messages, error"))
def stream_conversation_sink(spark, sf_dir):
    """Share pages as a stream: conversations with messages to JSON, the others to the quarantine."""
    pages = share.provider_pages(table(spark, sf_dir, "conversations"), "chatgpt")
    good, bad = streams.stored_batches(spark, pages, lambda batch: providers.assemble(providers.parse_pages(batch), "2024-02-29"))
    return good.select("page_id", F.size("messages").cast("long").alias("n_messages"), F.lit(None).cast("string").alias("error")).unionByName(bad.select("page_id", F.lit(None).cast("long").alias("n_messages"), "error"))


# -- extras, beyond the pages ----------------------------------------------------------------------------


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def ext_role_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("turn").alias("last_turn"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "n")
