"""Column expressions on text: white space, keys, titles, roles, providers, noise, escapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from turnloom.functions import rules

_SPACES = f"[{rules.SPACE_CLASS}]+"


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def collapse(value: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null as ''."""
    return F.trim(F.regexp_replace(_text(value), _SPACES, " "))


def blank(value: Column | str) -> Column:
    return collapse(value) == ""


#: Characters that composition leaves as they are, whatever stands beside them; all others may change.
COMPOSED = (
    r"\x{0}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{2AF}"
    r"\x{38E}-\x{3A1}\x{3A3}-\x{3CF}\x{3FA}-\x{482}\x{48A}-\x{52F}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20A9}-\x{20BF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FEF}\x{AC00}-\x{D7A3}"
)
#: A character that may change (most are told by the first range alone), and runs of them with the character
#: before them, with which the first may be composed.
_MAY = rf"[\x{{A0}}-\x{{10FFFF}}&&[^{COMPOSED}]]"
_OPEN = f"(?s).?{_MAY}+"


@F.pandas_udf(ArrayType(StringType()))
def nfkc(runs: pd.Series) -> pd.Series:
    """Compatibility composition of each text of a list; Spark has no function for it."""
    return runs.map(lambda r: None if r is None else [unicodedata.normalize("NFKC", t) for t in r])


def composed(value: Column | str) -> Column:
    """Compatibility composition; null as ''. Only what may change leaves the JVM, so that what Python holds
    does not grow with the texts; no character changes beyond such runs."""
    text = _text(value)
    may = (F.octet_length(text) != F.length(text)) & text.rlike(_MAY)
    made = nfkc(F.when(may, F.regexp_extract_all(text, F.lit(_OPEN), F.lit(0))))
    between = F.split(text, _OPEN, -1)
    return F.when(made.isNotNull(), F.array_join(F.zip_with(between, made, lambda one, two: F.concat(one, F.coalesce(two, F.lit("")))), "")).otherwise(text)


def dedupe_key(value: Column | str, normalize: bool = True) -> Column:
    """What texts are compared by: composed, without zero-width characters, collapsed, lower case.

    normalize: False leaves out the composition, and with it the only step outside the JVM; right where
    texts are known to be composed.
    """
    text = composed(value) if normalize else _text(value)
    return F.lower(collapse(F.regexp_replace(text, "[\\u200B-\\u200D\\uFEFF]", "")))


def escape_html(value: Column | str) -> Column:
    text = _text(value)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_title(value: Column | str) -> Column:
    return F.replace(_text(value), F.lit("<"), F.lit("&lt;"))


def escape_attribute(value: Column | str) -> Column:
    return F.replace(_text(value), F.lit('"'), F.lit("&quot;"))


def strip_tags(value: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(_text(value), "<[^>]+>", by)


def strip_title(value: Column | str) -> Column:
    """A page title without the brand after its last bar."""
    cut = F.regexp_replace(_text(value), rules.TITLE_SUFFIX.format(space=rules.SPACE_CLASS), "")
    return F.regexp_replace(F.regexp_replace(cut, rules.TITLE_EMPTY, ""), f"^{_SPACES}|{_SPACES}$", "")


def first_text(*values: Column | str) -> Column:
    """The first that is not empty, else ''."""
    return F.coalesce(*(F.nullif(_text(v), F.lit("")) for v in values), F.lit(""))


def date_label(value: Column | str, as_of: Column | str) -> Column:
    """The collapsed date text; where there is none, as_of in long English form."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return first_text(collapse(value), F.date_format(day, "EEEE, MMMM d, yyyy"))


def normalize_role(value: Column | str) -> Column:
    """user, assistant or '': by words within the letters of a role, user words first."""
    letters = F.regexp_replace(F.lower(_text(value)), "[^a-z]", "")
    return F.when(letters.rlike("|".join(rules.USER_WORDS)), "user").when(letters.rlike("|".join(rules.ASSISTANT_WORDS)), "assistant").otherwise("")


def detect_provider(html: Column | str, url: Column | str) -> Column:
    """By markers in the URL, else in the start of the page, else the default."""
    url, html = F.lower(_text(url)), F.lower(F.substring(_text(html), 1, rules.HTML_PREFIX))
    found = None
    for value, markers in ((url, rules.URL_MARKERS), (html, rules.HTML_MARKERS)):
        for provider, parts in markers:
            hit = F.lit(False)
            for part in parts:
                hit = hit | value.contains(part)
            found = F.when(hit, provider) if found is None else found.when(hit, provider)
    return found.otherwise("claude")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once. Spark puts an expression in wherever it is used, and works
    one inside of a function over an array out anew for each of its items."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda one, two: one | two, conditions)


def noise_prefix(value: Column | str, qwen: bool = False) -> Column:
    """Empty, one of the phrases, or a phrase and more words."""
    phrases = rules.NOISE_PREFIXES + (rules.NOISE_PREFIXES_QWEN if qwen else ())
    return let(F.lower(collapse(value)), lambda t: (t == "") | _any([(t == p) | F.startswith(t, F.lit(f"{p} ")) for p in phrases]))


def noise_part(value: Column | str, provider: str) -> Column:
    """Empty, or containing one of the provider's phrases anywhere."""
    return let(F.lower(collapse(value)), lambda t: (t == "") | _any([F.contains(t, F.lit(p)) for p in rules.NOISE_PARTS[provider]]))


def title_or_first_user(title: Column | str, messages: Column | str) -> Column:
    """The stripped title, else the first user's text (or the first text), cut to 78 characters."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    first = F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0)), F.get(messages, F.lit(0)))
    text = first["text"]
    cut = F.when(F.length(text) > 78, F.concat(F.substring(text, 1, 75), F.lit("..."))).otherwise(text)
    return first_text(strip_title(title), cut, F.lit(rules.DEFAULT_TITLE))


def small_bubble(value: Column | str) -> Column:
    """Short texts without line ends get a small bubble."""
    return (F.length(_text(value)) <= 16) & ~_text(value).rlike("[\\n\\r]")


def turn_key(turn_id: Column | str, container_id: Column | str, test_id: Column | str, turn: Column | str, text: Column | str) -> Column:
    """What a captured turn is known by: the first id that is set, else its role and the start of its text."""
    return first_text(turn_id, container_id, test_id, F.concat(_text(turn), F.lit(":"), F.substring(collapse(text), 1, 180)))
