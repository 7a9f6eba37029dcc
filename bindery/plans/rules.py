"""SQL of the text rules, written on their own for the other database."""

from __future__ import annotations

from bindery.functions import text as T
from bindery.plans.scalar_queries import KEY, LOW
from bindery.sources.corpus import SQL_SPACES


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"


def low(x: str) -> str:
    return LOW.format(x)


def key(x: str) -> str:
    return KEY.format(x)


def listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def any_of(x: str, words: list[str]) -> str:
    return f"len(list_filter({listed(words)}, lambda q: contains({x}, q))) > 0"


def statement(x: str) -> str:
    """A statement of copyright, or its sign misread."""
    v = squeezed(low(x))
    mark = f"CASE WHEN starts_with({v}, '(c)') THEN ltrim(substr({v}, 4), ' ') WHEN starts_with({v}, 'c') THEN ltrim(substr({v}, 2), ' ') WHEN substr({v}, 1, 2) IN ('0 ', 'o ') THEN ltrim(substr({v}, 3), ' ') END"
    return f"({any_of(v, T.STATEMENTS)} OR coalesce(regexp_matches(substr({mark}, 1, 4), '^[0-9]{{4}}$') AND TRY_CAST(substr({mark}, 1, 4) AS INTEGER) BETWEEN 1400 AND 2100 AND regexp_matches(substr({mark}, 5), '^,? +[a-z]'), false))"


def law(x: str) -> str:
    w = f"string_split({squeezed(low(x))}, ' ')"
    return f"""(len(list_filter(range(1, len({w}) + 1), lambda i: (regexp_matches({w}[i], '(^|[^a-z0-9_])act$') AND regexp_matches(coalesce(CASE WHEN {w}[i + 1] = 'of' THEN {w}[i + 2] ELSE {w}[i + 1] END, ''), '^[0-9]{{4}}([^a-z0-9_]|$)'))
      OR (regexp_matches({w}[i], '(^|[^a-z0-9_])(copyright|patent|patents|rights|protection)$') AND regexp_matches(coalesce({w}[i + 1], ''), '^act([^a-z0-9_]|$)')))) > 0)"""


def publisher(x: str) -> str:
    return f"({any_of(squeezed(low(x)), T.PUBLISHERS)} OR {statement(x)})"


def contents(x: str) -> str:
    return f"({key(x)} IN ('contents', 'table of contents', 'brief contents', 'contents at a glance'))"


def plain(x: str) -> str:
    return squeezed(f"replace({x}, chr(160), ' ')")


def name_like(x: str) -> str:
    v = plain(x)
    w = f"string_split({v}, ' ')"
    stop = listed(T.STOPWORDS)
    caps = f"(NOT regexp_matches({v}, '[a-z]'))"
    initial = "(regexp_matches(u, '^[B-Z]$') OR regexp_matches(u, '^[A-Z]\\.$'))"
    good = f"regexp_matches(u, '^[A-Z\\x{{C0}}-\\x{{1FFF}}\\x{{3000}}-\\x{{10FFFF}}]') AND ({initial} OR (NOT list_contains({stop}, {key('u')}) AND regexp_matches(substr(u, 2), '^[A-Za-z\\x{{80}}-\\x{{10FFFF}}\\x27.-]*$') AND ({caps} OR NOT regexp_matches(u, '^[A-Z][A-Z]'))))"
    spelled = f"NOT {initial} AND (regexp_matches(u, '^[^\\x00-\\x7F]') OR regexp_matches(substr(u, 2), '[a-z\\x{{80}}-\\x{{10FFFF}}]') OR ({caps} AND regexp_matches(substr(u, 2), '[A-Z]')))"
    apart = f"len(list_filter(range(1, len({w})), lambda i: length({w}[i]) = 1 AND list_contains({stop}, {key(w + '[i] || ' + w + '[i + 1]')}))) > 0"
    return f"(len({w}) BETWEEN 2 AND 5 AND NOT contains({v}, chr(173)) AND len(list_filter({w}, lambda u: NOT ({good}))) = 0 AND len(list_filter({w}, lambda u: {spelled})) > 0 AND NOT {apart})"



