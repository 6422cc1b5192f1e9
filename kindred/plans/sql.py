"""Pieces of SQL that say what the operators say, for differential checks."""

from __future__ import annotations

from ..functions import tables, text
from ..sources.readers import PARTIES_SQL, RECORDS_SQL


def norm(x: str) -> str:
    shown = f"regexp_replace(coalesce({x}, ''), '{text.INVISIBLE}', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(replace(lower({shown}), 'ß', 'ss'), '{text.OTHER}', ' ', 'g'), '{text.SPACE}', ' ', 'g'))"


def latin(x: str) -> str:
    return f"strip_accents({norm(x)})"


def expanded(x: str) -> str:
    for word, full in tables.EXPANSIONS:
        x = rf"regexp_replace({x}, '\b{word}\b', '{full}', 'g')"
    return f"trim({x})"


def clean(x: str) -> str:
    return expanded(latin(x))


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{text.SPACE}'), lambda w: w <> '')"


def soundex(w: str) -> str:
    """First letter and three digits; equal neighbours count once, H and W between them too."""
    x = f"regexp_replace(upper(replace({w}, 'ß', 'ss')), '[^A-Z]', '', 'g')"
    codes = f"string_split(translate({x}[1] || regexp_replace(substr({x}, 2), '[HW]', '', 'g'), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077'), '')"
    once = f"array_to_string(list_filter({codes}, lambda c, i: i = 1 OR c <> ({codes})[i - 1]), '')"
    return f"CASE WHEN {x} = '' THEN '' ELSE {x}[1] || rpad(substr(replace(substr({once}, 2), '0', ''), 1, 3), 3, '0') END"


def strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def terms(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


def numbers(x: str) -> str:
    return rf"list_distinct(list_filter({terms(x)}, lambda w: regexp_full_match(w, '\d+')))"


def pins(x: str) -> str:
    return rf"list_distinct(list_filter({terms(x)}, lambda w: regexp_full_match(w, '\d{{5,6}}')))"


def state(x: str, district: bool = True) -> str:
    known = strings(tables.STATES + [tables.DISTRICT] * district)
    return f"list_filter({terms(f'upper({x})')}, lambda w: list_contains({known}, w))[-1]"


def script(x: str) -> str:
    letters = rf"regexp_replace(coalesce({x}, ''), '\P{{L}}', '', 'g')"
    cols, names = [], [*tables.SCRIPTS]
    for i, ranges in enumerate(tables.SCRIPTS.values()):
        inside = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
        cols.append(f"length(regexp_replace({letters}, '[^{inside}]', '', 'g')) AS c{i}")
    n = len(names)
    total = f"length({letters})"
    first = "CASE " + " ".join(f"WHEN c{i} = m THEN '{names[i]}'" for i in range(n)) + " ELSE 'Other' END"
    return f"""(SELECT CASE WHEN coalesce({x}, '') = '' THEN 'Empty' WHEN t = 0 THEN 'Numeric/Symbol' WHEN m / t >= {tables.DOMINANT} THEN {first} ELSE 'Mixed' END
      FROM (SELECT *, greatest({", ".join(f"c{i}" for i in range(n))}, t - ({" + ".join(f"c{i}" for i in range(n))})) AS m FROM (SELECT {total} AS t, {", ".join(cols)})))"""


PAIRS = f"""{PARTIES_SQL},
ref AS (SELECT *, regexp_extract(business_address, '^NATION \\d+') AS nation FROM parties WHERE entity_id LIKE 'S1-%'),
qry AS (SELECT *, regexp_extract(business_address, '^NATION \\d+') AS nation FROM parties WHERE entity_id NOT LIKE 'S1-%'),
pairs AS (SELECT query_id, s1_id FROM (
  SELECT q.entity_id AS query_id, r.entity_id AS s1_id FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY key) AS rn FROM ref) r JOIN qry q ON q.nation = r.nation WHERE rn <= 20
  UNION SELECT q.entity_id, r.entity_id FROM qry q JOIN ref r ON q.key = r.key) u),
truth AS (SELECT r.entity_id AS s1_id, q.entity_id AS query_id FROM qry q JOIN ref r ON q.key = r.key),
met AS (SELECT query_id, s1_id, q.business_name AS qn, r.business_name AS sn, q.business_address AS qa, r.business_address AS sa, q.country AS qc, r.country AS sc
  FROM pairs JOIN qry q ON q.entity_id = query_id JOIN ref r ON r.entity_id = s1_id),
scored AS (SELECT query_id, s1_id, round(1 - levenshtein(lower(qn || ' ' || qa), lower(sn || ' ' || sa)) / greatest(length(qn || ' ' || qa), length(sn || ' ' || sa)), 6) AS score FROM met)"""

RECORDS = RECORDS_SQL
#: Records of documents by side, with equal texts across sides as truth.
SIDES = f"""{RECORDS_SQL},
ref AS (SELECT * FROM records WHERE entity_id LIKE 'S1-%'), qry AS (SELECT * FROM records WHERE entity_id NOT LIKE 'S1-%'),
truth AS (SELECT r.entity_id AS s1_id, q.entity_id AS query_id FROM qry q JOIN ref r ON q.business_name = r.business_name AND q.business_address = r.business_address AND q.country = r.country)"""
