"""The stemmer in SQL, from the published rules, for the SQL of other queries."""

from __future__ import annotations

from ..functions import keys, stem


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[aeiouy]+[^aeiouy]+'))"


def _vowel(x: str) -> str:
    return f"regexp_matches({x}, '[aeiouy]')"


def _short(x: str) -> str:
    return f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$')"


def _double(x: str) -> str:
    return f"(lower(right({x}, 1)) = lower(right(left({x}, -1), 1)) AND NOT {_vowel(f'right({x}, 1)')} AND length({x}) > 1)"


def _suffixes(table: dict[str, str], least: int) -> str:
    """CASE over suffixes, the longest first; an empty condition for a suffix ends the step."""
    rows = []
    for end in sorted(table, key=len, reverse=True):
        rest = f"left(w, -{len(end)})"
        last = f" AND regexp_matches({rest}, '[st]$')" if end == "ion" else ""
        rows.append(f"WHEN w LIKE '%{end}' THEN CASE WHEN {_measure(rest)} > {least}{last} THEN {rest} || '{table[end]}' ELSE w END")
    return f"CASE {' '.join(rows)} ELSE w END"


#: Tables (word, stem) of the words of a table vocab, and terms (word, term): the stem and an acronym's words.
TERMS = f"""
st0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), '(y)y', '\\1Y', 'g') AS w FROM vocab WHERE word IS NOT NULL),
st1 AS (SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END AS w FROM st0),
st2 AS (SELECT word, w LIKE '%eed' AS eed, w NOT LIKE '%eed' AND (w LIKE '%ed' AND {_vowel('left(w, -2)')} OR w LIKE '%ing' AND {_vowel('left(w, -3)')}) AS cut, w AS o, CASE WHEN w LIKE '%ed' THEN left(w, -2) ELSE left(w, -3) END AS w FROM st1),
st3 AS (SELECT word, CASE WHEN eed THEN CASE WHEN {_measure('left(o, -3)')} > 0 THEN left(o, -1) ELSE o END WHEN NOT cut THEN o WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
  WHEN {_double('w')} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN CASE WHEN {_measure('w')} = 1 AND {_short('w')} THEN w || 'e' ELSE w END ELSE left(w, -1) END
  WHEN {_measure('w')} = 1 AND {_short('w')} THEN w || 'e' ELSE w END AS w FROM st2),
st4 AS (SELECT word, CASE WHEN lower(right(w, 1)) = 'y' AND {_vowel('left(w, -1)')} THEN left(w, -1) || 'i' ELSE w END AS w FROM st3),
st5 AS (SELECT word, {_suffixes(stem.STEP2, 0)} AS w FROM st4),
st6 AS (SELECT word, {_suffixes(stem.STEP3, 0)} AS w FROM st5),
st7 AS (SELECT word, {_suffixes(dict.fromkeys(stem.STEP4, ''), 1)} AS w FROM st6),
st8 AS (SELECT word, CASE WHEN w LIKE '%e' AND ({_measure('left(w, -1)')} > 1 OR {_measure('left(w, -1)')} = 1 AND NOT {_short('left(w, -1)')}) THEN left(w, -1) ELSE w END AS w FROM st7),
st9 AS (SELECT word, CASE WHEN w LIKE '%ll' AND {_measure('w')} > 1 THEN left(w, -1) ELSE w END AS w FROM st8),
stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN length(w) > 4 AND w LIKE '%fi' THEN lower(left(w, -1)) ELSE lower(w) END AS stem FROM st9),
terms AS (SELECT word, stem AS term FROM stems UNION SELECT acronym, unnest(string_split(written, ' ')) FROM (VALUES {', '.join(f"('{k}', '{' '.join(w for w in v.split() if w not in keys.STOPWORDS)}')" for k, v in keys.ACRONYMS.items())}) a(acronym, written) WHERE acronym IN (SELECT word FROM stems))"""
