"""The same queries in DuckDB SQL over the shared test tables."""

from __future__ import annotations

from checks.testbed import CITIES, FAMILY, GIVEN
from kindred.functions.cleanse import PII_PATTERNS
from kindred.functions.dims import CITY_COORDS, NAME_GENDER, PLACE_ABBREVIATIONS

AS_OF = "TIMESTAMP '2000-01-01'"
CUTOFF = "TIMESTAMP '1999-01-01'"


def _list(words: list[str]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _given(key: str) -> str:
    return f"{_list(GIVEN)}[({key}) % 24 + 1]"


def _family(key: str) -> str:
    first = f"{_list(FAMILY)}[(({key}) // 24) % 40 + 1]"
    second = f"{_list(FAMILY)}[(({key}) // 960) % 40 + 1]"
    return f"({first} || CASE WHEN {key} >= 960 THEN '-' || {second} ELSE '' END)"


def _city(i: str) -> str:
    return f"{_list(CITIES)}[({i}) % 25 + 1]"


def _rid(key: str) -> str:
    k = f"CAST({key} AS VARCHAR)"
    return f"('R-' || CASE WHEN length({k}) < 8 THEN lpad({k}, 8, '0') ELSE {k} END)"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def _with(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTE[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
    return f"WITH {head}\n{body}" if order else body


_cte("records", f"""
SELECT {_rid('o_orderkey')} AS record_id, o_custkey AS person_id,
  {_given('o_custkey')} AS given_name, {_family('o_custkey')} AS family_name,
  CAST(1825 + (year(o_orderdate) - 1995) * 9 + o_orderkey % 9 AS INTEGER) AS event_year,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS event_month,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(1755 + (o_custkey * 37) % 90
    + CASE WHEN o_orderkey % 11 = 0 THEN 15 ELSE 0 END AS INTEGER) END AS birth_year,
  CASE WHEN o_orderkey % 50 <> 0 THEN {_city('c_nationkey + o_orderkey % 3')} END AS location,
  o_orderpriority AS source, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate END AS updated_at,
  o_orderkey AS order_key
FROM orders JOIN customer ON o_custkey = c_custkey""")

_cte("queries", f"""
SELECT c_custkey AS query_id, {_given('c_custkey')} AS given_name,
  CASE WHEN c_custkey % 5 = 4 THEN left({_family('c_custkey')}, 4)
       ELSE {_family('c_custkey')} END AS family_name,
  CASE WHEN c_custkey % 5 <> 1 THEN CAST(1830 + (c_custkey * 7) % 50 AS INTEGER) END AS approx_year,
  CASE WHEN c_custkey % 5 = 3 THEN '' WHEN c_custkey % 5 <> 2
       THEN trim({_city('c_nationkey')}) END AS location
FROM customer""")

_cte("vectors", f"""SELECT {_rid('vec_id')} AS record_id,
  CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""")
_cte("query_vectors", """SELECT vec_id AS query_id,
  CAST(embedding AS DOUBLE[]) AS query_vector FROM embeddings""")

_cte("requests", """
SELECT location || '/' || year AS request_id, location, year FROM (
  SELECT DISTINCT trim(location) AS location, CAST(event_year // 10 * 10 AS INTEGER) AS year
  FROM records WHERE location IS NOT NULL
  UNION ALL SELECT 'Nowhere ' || r_name, 1850 FROM region)""", "records")

_cte("geo", "SELECT * FROM (VALUES " + ",".join(
    f"('{k}', {la}::DOUBLE, ({lo})::DOUBLE)" for k, (la, lo) in CITY_COORDS.items())
    + ") t(name, lat, lon)")
_cte("genders", "SELECT * FROM (VALUES " + ",".join(
    f"('{k}', '{g}')" for k, g in NAME_GENDER.items()) + ") t(name, gender)")

_cte("g", """SELECT lower(trim(given_name)) AS name, min(CASE length(given_name) % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' END) AS gender
  FROM records WHERE given_name IS NOT NULL GROUP BY 1""", "records")

_SIDES = [("record_id", "id"), ("given_name", "given"), ("family_name", "family"),
          ("location", "location"), ("event_year", "year"), ("event_month", "month"),
          ("birth_year", "birth")]
_cte("pairs", "SELECT " + ", ".join(f"a.{c} AS from_{n}, b.{c} AS to_{n}" for c, n in _SIDES) + """
FROM records a JOIN records b ON lower(a.family_name) = lower(b.family_name)
  AND abs(a.event_year - b.event_year) <= 5
  AND (a.event_year < b.event_year OR (a.event_year = b.event_year AND a.record_id < b.record_id))""", "records")

# travel and rules over any table "pairs_in" with from_* / to_* columns
_CHECK = """
SELECT *, travel_days > available_days AS r1,
  coalesce(NOT (bio_from BETWEEN 0 AND 120 AND bio_to BETWEEN 0 AND 120), false) AS r2,
  coalesce(from_birth, to_birth) IS NOT NULL
    AND NOT (age_from BETWEEN 0 AND 120 AND age_to BETWEEN 0 AND 120) AS r3i,
  coalesce(from_birth, to_birth) IS NOT NULL
    AND age_from BETWEEN 0 AND 120 AND age_to BETWEEN 0 AND 120
    AND abs(age_to - age_from) > abs(to_year - from_year) + 5 AS r3c,
  g_from IN ('MALE','FEMALE') AND g_to IN ('MALE','FEMALE') AND g_from <> g_to AS r4,
  available_days - travel_days >= 0 AND available_days - travel_days < 5 AS r5
FROM (SELECT *, distance / speed AS travel_days,
    from_year - coalesce(from_birth, to_birth) AS bio_from,
    to_year - coalesce(from_birth, to_birth) AS bio_to,
    from_year - coalesce(from_birth, to_birth) AS age_from,
    to_year - coalesce(to_birth, from_birth) AS age_to,
    CASE WHEN from_year = to_year AND from_month IS NULL AND to_month IS NULL THEN 182.5
      ELSE greatest(1.0, abs(to_year - from_year) * 365.0 + coalesce(
        CASE WHEN to_year < from_year THEN from_month - to_month ELSE to_month - from_month END, 0)
        * 30.0) END::DOUBLE AS available_days
  FROM (SELECT *, CASE mode WHEN 'ocean_ship' THEN 150.0 WHEN 'horse_coach' THEN 50.0
      WHEN 'railroad_eastern' THEN 200.0 ELSE 400.0 END::DOUBLE AS speed,
      CASE WHEN mode = 'ocean_ship' THEN greatest(straight, 18000.0) ELSE straight END AS distance
    FROM (SELECT *, 3958.8 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS straight,
        CASE WHEN ((flon > (-100)) <> (tlon > (-100))) AND from_year < 1869 THEN 'ocean_ship'
          WHEN from_year < 1830 THEN 'horse_coach' WHEN from_year < 1869 THEN 'railroad_eastern'
          ELSE 'railroad_transcontinental' END AS mode
      FROM (SELECT *, pow(sin(radians(tlat - flat) / 2), 2)
          + cos(radians(flat)) * cos(radians(tlat)) * pow(sin(radians(tlon - flon) / 2), 2) AS a
        FROM (SELECT p.*, coalesce(cf.lat, 39.5) AS flat, coalesce(cf.lon, -98.35) AS flon,
            coalesce(ct.lat, 39.5) AS tlat, coalesce(ct.lon, -98.35) AS tlon,
            coalesce(gf.gender, 'UNKNOWN') AS g_from, coalesce(gt.gender, 'UNKNOWN') AS g_to
          FROM {pairs} p
          LEFT JOIN geo cf ON cf.name = lower(trim(p.from_location))
          LEFT JOIN geo ct ON ct.name = lower(trim(p.to_location))
          LEFT JOIN genders gf ON gf.name = lower(trim(p.from_given))
          LEFT JOIN genders gt ON gt.name = lower(trim(p.to_given)))))))"""
_RULES = """[CASE WHEN r1 THEN 'physical_impossibility' END,
  CASE WHEN r2 THEN 'biological_plausibility' END,
  CASE WHEN r3i OR r3c THEN 'AgeConsistencyRule' END,
  CASE WHEN r4 THEN 'GenderPlausibilityRule' END, CASE WHEN r5 THEN 'narrow_margin' END]"""
_POINTS = """[CASE WHEN r1 THEN 'physical_impossibility=50' END,
  CASE WHEN r2 THEN 'biological_plausibility=50' END,
  CASE WHEN r3i THEN 'AgeConsistencyRule=50' WHEN r3c THEN 'AgeConsistencyRule=40' END,
  CASE WHEN r4 THEN 'GenderPlausibilityRule=20' END, CASE WHEN r5 THEN 'narrow_margin=15' END]"""
_SUM = """CAST(least(50, (CASE WHEN r1 THEN 50 ELSE 0 END) + (CASE WHEN r2 THEN 50 ELSE 0 END)
  + (CASE WHEN r3i THEN 50 WHEN r3c THEN 40 ELSE 0 END) + (CASE WHEN r4 THEN 20 ELSE 0 END)
  + (CASE WHEN r5 THEN 15 ELSE 0 END)) AS INTEGER)"""
_PLAUSIBLE = "NOT (r1 OR r2 OR r3i OR r3c)"
_cte("checked", _CHECK.format(pairs="pairs"), "pairs", "geo", "genders")

_TIER = """CASE WHEN travel_days > available_days THEN 'impossible'
  WHEN travel_days = 0 OR available_days / travel_days >= 10 THEN 'very_comfortable'
  WHEN available_days / travel_days >= 4 THEN 'comfortable'
  WHEN available_days / travel_days >= 2 THEN 'moderate' ELSE 'tight' END"""

_cte("found", """
SELECT q.query_id, r.record_id, r.given_name, r.family_name, r.event_year, r.location,
  row_number() OVER (PARTITION BY q.query_id ORDER BY
    CASE WHEN lower(r.family_name) = lower(q.family_name) THEN 0 ELSE 1 END,
    CASE WHEN lower(r.given_name) = lower(q.given_name) THEN 0 ELSE 1 END,
    r.event_year ASC NULLS LAST, r.record_id) AS rank
FROM queries q JOIN records r ON contains(lower(r.family_name), lower(q.family_name))
  AND contains(lower(r.given_name), lower(q.given_name))
  AND (q.approx_year IS NULL OR abs(r.event_year - q.approx_year) <= 5)
  AND (q.location IS NULL OR q.location = '' OR contains(lower(r.location), lower(q.location)))
QUALIFY rank <= 20""", "queries", "records")

_cte("scored", """
SELECT f.*, list_cosine_similarity(v.embedding, qv.query_vector) AS sim
FROM found f LEFT JOIN vectors v USING (record_id) LEFT JOIN query_vectors qv USING (query_id)""",
     "found", "vectors", "query_vectors")
_cte("reranked", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sim, -1) DESC, rank) AS new_rank,
  bool_or(sim IS NOT NULL) OVER (PARTITION BY query_id) AS rerank_applied
FROM scored""", "scored")

_cte("near", """
SELECT q.request_id, r.record_id, r.given_name, r.family_name, r.event_year, r.location,
  row_number() OVER (PARTITION BY q.request_id ORDER BY r.event_year, r.record_id) AS rank
FROM requests q JOIN records r ON contains(lower(r.location), lower(q.location))
  AND abs(r.event_year - q.year) <= 5""", "requests", "records")

_DEFECTS = [17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61]
_KIND = "CASE " + " ".join(f"WHEN o_orderkey % {d} = 0 THEN {d}" for d in _DEFECTS) + " ELSE 0 END"
_cte("landing", f"""
SELECT 'landing/batch-' || (o_orderkey % 20) || '.ndjson' AS source_key,
  o_orderkey // 20 + 1 AS source_line,
  CASE WHEN kind = 31 THEN 'not json ' || o_orderkey ELSE '{{' || concat_ws(',',
    '"recordId":' || CASE WHEN kind = 19 THEN 'null' WHEN kind = 59 THEN '"0"' ELSE '"' || {_rid('o_orderkey')} || '"' END,
    '"givenName":"' || CASE WHEN kind = 43 THEN '  ' || lower(g) || ' ' ELSE g END || '"',
    CASE WHEN kind <> 17 THEN '"familyName":"' || CASE WHEN kind = 43 THEN lower(f) || '  '
      ELSE f END || '"' END,
    '"eventYear":' || CASE WHEN kind = 23 THEN '"' || y || '"' WHEN kind = 29 THEN '2099'
      ELSE CAST(y AS VARCHAR) END,
    '"location":"' || CASE WHEN kind = 41 THEN '   ' ELSE {_city('c_nationkey')} END || '"',
    CASE WHEN kind = 53 THEN '"birthYear":' || (y + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -20 END) || '.5'
      WHEN o_orderkey % 6 <> 0 THEN '"birthYear":' || CASE WHEN kind = 37
      THEN y + o_orderkey % 3 ELSE y - 5 - (o_custkey * 37) % 120 END END,
    CASE WHEN kind = 47 THEN
      '"rawContent":"SSN 123-45-6789, mail a.b@example.org, call (617) 555-1212."' END,
    CASE WHEN o_orderkey % 10 = 0 THEN '"computeEmbedding":false' END,
    CASE WHEN kind = 61 THEN '"note":"n' || o_orderkey || '"' END) || '}}' END AS value
FROM (SELECT *, {_KIND} AS kind, {_given('o_custkey')} AS g, {_family('o_custkey')} AS f,
    1825 + (year(o_orderdate) - 1995) * 9 + o_orderkey % 9 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)
UNION ALL SELECT 'landing/nations.ndjson', n_nationkey + 1, n_nationkey || ',' || n_name FROM nation""")

_TITLE = ("array_to_string(list_transform(regexp_extract_all({0}, '[\\pL]+|[^\\pL]+'), "
          "lambda t: upper(t[1]) || lower(t[2:])), '')")
_txt = lambda f: f"trim(json_extract_string(j, '$.{f}'))"
_cte("parsed", f"""
SELECT *, json_type(j, '$.recordId') AS t_id, json_type(j, '$.familyName') AS t_family,
  {_txt('recordId')} AS record_id, {_TITLE.format(_txt('givenName'))} AS given_name,
  {_TITLE.format(_txt('familyName'))} AS family_name,
  CAST({_txt('eventYear')} AS BIGINT) AS event_year,
  CASE WHEN json_type(j, '$.birthYear') <> 'DOUBLE' THEN CAST({_txt('birthYear')} AS BIGINT) END AS birth_year,
  {_txt('birthYear')} AS birth_text, CAST({_txt('birthYear')} AS DOUBLE) AS birth_number,
  CASE WHEN json_type(j, '$.note') IS NOT NULL THEN '{{"note":"' || json_extract_string(j, '$.note') || '"}}'
    WHEN json_type(j, '$.birthYear') = 'DOUBLE' THEN '{{"birthYear":' || {_txt('birthYear')} || '}}' END AS extra, {_txt('location')} AS location,
  json_extract_string(j, '$.rawContent') AS raw_content,
  CAST(json_extract_string(j, '$.computeEmbedding') AS BOOLEAN) AS compute_embedding
FROM (SELECT *, CASE WHEN json_valid(value) THEN
    CASE WHEN json_type(value) = 'OBJECT' THEN CAST(value AS JSON) END END AS j FROM landing)""",
     "landing")
_cte("ruled", """
SELECT *, CASE WHEN j IS NULL THEN ['invalid JSON']
  WHEN t_id = 'NULL' THEN ['null required field: recordId']
  WHEN t_family IS NULL THEN ['missing required field: familyName']
  ELSE list_filter([
    CASE WHEN event_year NOT BETWEEN 1800 AND 1950
      THEN 'eventYear ' || event_year || ' out of range [1800–1950]' END,
    CASE WHEN birth_number >= event_year
      THEN 'birthYear ' || birth_text || ' >= eventYear ' || event_year
      WHEN event_year - birth_year NOT BETWEEN 1 AND 110
      THEN 'implied age ' || (event_year - birth_year) || ' outside [1–110]' END,
    CASE WHEN location = '' THEN 'location is empty after strip' END], lambda x: x IS NOT NULL) END AS reasons
FROM parsed""", "parsed")
_cte("kept", """SELECT *, CASE WHEN count(j) OVER (PARTITION BY source_key) = 0 THEN 'no valid JSON lines' END AS file_reason
FROM ruled""", "ruled")
_cte("seen", """
SELECT source_key, reason, count(*) AS lines, min(source_line) AS first_line,
  arg_min(pos, source_line * 10 + pos) AS first_pos
FROM (SELECT source_key, source_line, unnest(rs) AS reason, unnest(range(len(rs))) AS pos
  FROM (SELECT *, CASE WHEN file_reason IS NULL THEN reasons ELSE [file_reason] END AS rs FROM kept WHERE len(reasons) > 0))
GROUP BY 1, 2""", "kept")

_cte("arrivals", f"""
SELECT {_rid('CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END')} AS record_id,
  {_given('l_partkey')} AS given_name, {_family('l_partkey')} AS family_name,
  CASE WHEN l_partkey % 7 <> 0 THEN CAST(1830 + l_partkey % 60 AS INTEGER) END AS event_year,
  CASE WHEN l_partkey % 5 <> 0 THEN CAST(1790 + l_partkey % 40 AS INTEGER) END AS birth_year,
  CASE WHEN l_partkey % 9 <> 0 THEN {_city('l_partkey')} END AS location,
  l_returnflag AS source,
  (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS arrival
FROM lineitem""")
_PICK = """SELECT * FROM arrivals QUALIFY row_number() OVER (
  PARTITION BY record_id ORDER BY arrival {dir}) = 1"""
_cte("latest", _PICK.format(dir="DESC"), "arrivals")
_cte("earliest", _PICK.format(dir="ASC"), "arrivals")
_cte("archived", f"SELECT * FROM records WHERE created_at < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY", "records")
_cte("ev", """SELECT ts, event_id AS batch_id, 1 AS ingress,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS quarantined, value * 100 AS latency_ms FROM events""")

_elements = lambda c: f"array_to_string(list_transform({c}, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ',')"
_letters = lambda t: "concat_ws(',', " + ", ".join(f"1000000 * (length({t}) - length(replace({t}, '{x}', '')))" for x in "aeinotRS") + ")"
_day = lambda c, name=None: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"
_TEXT = """'givenName=' || given_name || ' familyName=' || family_name
  || coalesce(' year=' || {year}, '')
  || CASE WHEN trim(coalesce(location, '')) <> '' THEN ' location=' || location ELSE '' END"""
_OCR = ("array_to_string(list_transform(regexp_extract_all({0}, '[0-9A-Za-z_]+|[^0-9A-Za-z_]+'), "
        "lambda t: CASE WHEN regexp_full_match(t, '[0-9IlSO]{{4}}') "
        "THEN translate(t, 'SOlI', '5011') ELSE t END), '')")


def _place(text: str) -> str:
    words = "CASE lower(t) " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in PLACE_ABBREVIATIONS.items()) + " ELSE t END"
    return (f"array_to_string(list_transform(regexp_extract_all({text}, "
            f"'[0-9A-Za-z_]+|[^0-9A-Za-z_]+'), lambda t: {words}), '')")


def _redact(text: str) -> str:
    for p in PII_PATTERNS.values():
        text = f"regexp_replace({text}, '{p}', '[REDACTED]', 'g')"
    return text


def _blank(c: str) -> str:
    return f"trim(coalesce({c}, ''), ' \t\n\r') = ''"


def _cleansed(c: str) -> str:
    return f"CASE WHEN {_blank(c)} THEN {c} ELSE {_place(_OCR.format(c))} END"


_UPSERTED = f"""
SELECT coalesce(r.record_id, n.record_id) AS record_id,
  """ + ",\n  ".join(f"CASE WHEN n.record_id IS NOT NULL THEN n.{c} ELSE r.{c} END AS {c}" for c in (
    "given_name", "family_name", "event_year", "birth_year", "location", "source")) + f""",
  strftime(coalesce(r.created_at, {AS_OF}), '%Y-%m-%d %H:%M:%S') AS created_at,
  strftime(CASE WHEN n.record_id IS NOT NULL THEN {AS_OF} ELSE r.updated_at END,
    '%Y-%m-%d %H:%M:%S') AS updated_at
FROM records r FULL OUTER JOIN latest n ON r.record_id = n.record_id"""

_VERDICT = """CASE WHEN coalesce(from_birth, to_birth) IS NULL THEN 'UNKNOWN' WHEN r3i THEN 'IMPLAUSIBLE'
  WHEN r3c THEN 'CONTRADICTS' ELSE 'CONSISTENT' END"""
_AGE_REASON = """CASE WHEN coalesce(from_birth, to_birth) IS NULL
  THEN 'No birth year available on either record; age consistency check skipped.'
  WHEN r3i THEN printf('Implied ages (%d, %d) outside viable range [0, 120].', age_from, age_to)
  WHEN r3c THEN printf('Age delta %d exceeds year delta %d by more than 5 — records contradict same-person identity.',
    abs(age_to - age_from), abs(to_year - from_year))
  ELSE printf('Ages consistent: %d at %d → %d at %d (year delta %+d, age delta %d).',
    age_from, from_year, age_to, to_year, to_year - from_year, abs(age_to - age_from)) END"""
_REASONS = f"""
SELECT from_id, to_id, 'physical_impossibility' AS rule_name, r1 AS triggered, CASE WHEN r1
    THEN printf('Travel requires %.1f days but only %.1f days available (mode: %s).', travel_days, available_days, mode)
    ELSE 'Travel is physically possible.' END AS reason FROM checked
UNION ALL SELECT from_id, to_id, 'biological_plausibility', r2, CASE
    WHEN coalesce(from_birth, to_birth) IS NULL THEN 'No birth year available; biological check skipped.'
    WHEN r2 THEN printf('Implied ages (%d, %d) are outside plausible range [0, 120].', bio_from, bio_to)
    ELSE printf('Ages at records (%d, %d) are biologically plausible.', bio_from, bio_to) END FROM checked
UNION ALL SELECT from_id, to_id, 'AgeConsistencyRule', r3i OR r3c, {_AGE_REASON} FROM checked
UNION ALL SELECT from_id, to_id, 'GenderPlausibilityRule', r4, CASE
    WHEN g_from NOT IN ('MALE','FEMALE') OR g_to NOT IN ('MALE','FEMALE')
    THEN printf('skipped — gender ambiguous or unknown for ''%s''/''%s''', from_given, to_given)
    WHEN r4 THEN printf('gender conflict: ''%s'' inferred %s vs ''%s'' inferred %s', from_given, g_from, to_given, g_to)
    ELSE printf('gender consistent: both inferred %s', g_from) END FROM checked
UNION ALL SELECT from_id, to_id, 'narrow_margin', r5, CASE WHEN r5
    THEN printf('Margin of %.1f days is tight (threshold: 5 days).', available_days - travel_days)
    ELSE printf('Margin of %.1f days is comfortable.', available_days - travel_days) END FROM checked"""

_cte("tops", """
SELECT q.*, coalesce(n, 0) AS n, coalesce(applied, false) AS applied, ranked, best,
  t.record_id AS top_id, t.given_name AS top_given, t.family_name AS top_family,
  t.event_year AS top_year, t.location AS top_location,
  t.record_id IS NOT NULL AND trim(coalesce(q.location, '')) <> '' AND q.approx_year IS NOT NULL
    AND t.event_year IS NOT NULL AND trim(coalesce(t.location, '')) <> '' AS checkable
FROM queries q
LEFT JOIN (SELECT query_id, count(*) AS n, bool_or(rerank_applied) AS applied, max(sim) AS best,
    string_agg(record_id, '|' ORDER BY new_rank) AS ranked FROM reranked GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT * FROM reranked WHERE new_rank = 1) t ON t.query_id = q.query_id""",
     "queries", "reranked")
_cte("top_pairs", """SELECT query_id, 'query' AS from_id, given_name AS from_given,
  location AS from_location, approx_year AS from_year, NULL::INTEGER AS from_month,
  NULL::INTEGER AS from_birth, top_id AS to_id, top_given AS to_given, top_location AS to_location,
  top_year AS to_year, NULL::INTEGER AS to_month, NULL::INTEGER AS to_birth
FROM tops WHERE checkable""", "tops")
_cte("top_checked", _CHECK.format(pairs="top_pairs"), "top_pairs", "geo", "genders")

_SCORE = """(CASE WHEN n = 0 THEN 0.15 ELSE least(0.95, 0.45 + least(0.3, n * 0.15)
  + CASE WHEN approx_year IS NOT NULL THEN 0.1 ELSE 0 END
  + CASE WHEN trim(coalesce(location, '')) <> '' THEN 0.1 ELSE 0 END
  + CASE WHEN best >= 0.85 THEN 0.05 ELSE 0 END) END)::DOUBLE"""
_HAS_PLACE = "trim(coalesce(t.location, '')) <> ''"
_RESOLVE = f"""
SELECT t.query_id,
  'sql-search → vector-rerank → semantic-summary → spatiotemporal-validation' AS strategy,
  (SELECT count(*) FROM records) AS total_candidates, CAST(n AS INTEGER) AS deterministic_matches,
  coalesce(ranked, '') AS ranked,
  round(CASE WHEN adj > 0 THEN greatest(0.05, score - adj / 100.0) ELSE score END, 4) AS confidence_score,
  concat_ws('|', 'SQL search reduced ' || (SELECT count(*) FROM records) || ' records to ' || n || ' candidates.',
    CASE WHEN applied THEN 'Reranked by cosine similarity of vectors.' END,
    CASE WHEN approx_year IS NOT NULL THEN 'Applied year window ±5.' END,
    CASE WHEN {_HAS_PLACE} THEN 'Applied location filter.' END,
    CASE WHEN checkable THEN printf('Spatio-temporal validation: plausible=%s mode=%s travelDays=%.1f availDays=%.1f.',
      CAST({_PLAUSIBLE} AS VARCHAR), mode, travel_days, available_days) END) AS reasons,
  concat_ws('|', 'sql_search', CASE WHEN approx_year IS NOT NULL THEN 'year_window_filter' END,
    CASE WHEN {_HAS_PLACE} THEN 'location_filter' END,
    CASE WHEN applied THEN 'hybrid_vector_rerank' END, 'semantic_llm_summary_disabled',
    CASE WHEN checkable THEN 'spatiotemporal_validation' END) AS rules_triggered,
  CASE WHEN n = 0 THEN 'No candidates found.' ELSE 'Top deterministic candidate: ' || top_id || ' ('
    || top_given || ' ' || top_family || ', ' || coalesce(CAST(top_year AS VARCHAR), 'null') || ', '
    || coalesce(top_location, 'null') || ').' END AS semantic_summary,
  {_PLAUSIBLE} AS plausible, mode AS transit_mode, adj AS confidence_adjustment
FROM (SELECT *, {_SCORE} AS score FROM tops) t
LEFT JOIN (SELECT *, {_SUM} AS adj FROM top_checked) c ON c.query_id = t.query_id"""

_PROMPT = r"""
SELECT q.query_id, 'Task: decide which stored record, if any, describes the person asked for, and say why.' || chr(10) || chr(10)
  || 'Asked for: ' || q.given_name || ' ' || q.family_name || coalesce(', about ' || q.approx_year, '')
  || CASE WHEN trim(coalesce(q.location, '')) <> '' THEN ', in ' || q.location ELSE '' END
  || chr(10) || chr(10) || 'Records, best first (id | name | year | place | vector similarity):' || chr(10)
  || coalesce(lines, '') || chr(10) || 'Answer in a few plain sentences and state how sure you are.'
  AS summary_prompt
FROM queries q LEFT JOIN (SELECT query_id, string_agg('  ' || rank || '. ' || record_id || ' | '
    || given_name || ' ' || family_name || ' | ' || coalesce(CAST(event_year AS VARCHAR), 'null') || ' | '
    || coalesce(location, 'null') || ' | n/a' || chr(10), '' ORDER BY rank) AS lines
  FROM found GROUP BY 1) USING (query_id)"""

_SNAP = """
SELECT q.request_id, coalesce(n, 0) AS record_count, coalesce(names, '') AS common_names,
  coalesce(lo, q.year) AS year_range_min, coalesce(hi, q.year) AS year_range_max,
  CASE WHEN n IS NULL THEN printf('No records found near %s around %d.', q.location, q.year)
    ELSE printf('%d records found near %s around %d. Common names: %s.', n, q.location, q.year,
      replace(names, '|', ', ')) END AS context_summary,
  printf('Task: describe life in %s about the year %d to a family historian, in three sentences at most.',
    q.location, q.year) || chr(10)
  || printf('Records held for that place and time: %d.', coalesce(n, 0)) || chr(10)
  || printf('Most frequent names: %s.', coalesce(replace(names, '|', ', '), 'none')) || chr(10) AS summary_prompt
FROM requests q
LEFT JOIN (SELECT request_id, count(*) AS n, min(event_year) AS lo, max(event_year) AS hi
  FROM near GROUP BY 1) USING (request_id)
LEFT JOIN (SELECT request_id, string_agg(name, '|' ORDER BY c DESC, name) AS names FROM (
    SELECT request_id, given_name || ' ' || family_name AS name, count(*) AS c FROM near GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY c DESC, name) <= 5)
  GROUP BY 1) USING (request_id)"""


def _bucket(width: str) -> str:
    return f"time_bucket(INTERVAL '{width}', ts)"


ORACLE: dict[str, str] = {
    "candidate_pairs": _with("SELECT from_id, to_id, from_year, to_year FROM pairs", "pairs"),
    "pair_plausibility": _with(f"""SELECT from_id, to_id, {_PLAUSIBLE} AS plausible,
  round(travel_days, 4) AS travel_days, available_days, round(available_days - travel_days, 4) AS margin,
  mode AS transit_mode, coalesce(array_to_string({_RULES}, '|'), '') AS rules_triggered,
  {_SUM} AS confidence_adjustment, coalesce(array_to_string({_POINTS}, '|'), '') AS rule_penalties FROM checked""", "checked"),
    "transit_modes": _with("""SELECT mode AS transit_mode, speed AS speed_miles_per_day, count(*) AS pairs,
  round(min(travel_days), 4) AS min_days, round(max(travel_days), 4) AS max_days,
  round(avg(distance), 2) AS avg_miles FROM checked GROUP BY 1, 2""", "checked"),
    "available_days": _with("SELECT from_id, to_id, available_days AS days FROM checked", "checked"),
    "age_verdicts": _with(f"""SELECT from_id, to_id, {_VERDICT} AS verdict, age_from, age_to,
  {_AGE_REASON} AS reason FROM checked""", "checked"),
    "age_viability": _with("""SELECT record_id, event_year - birth_year AS age,
  coalesce(event_year - birth_year BETWEEN 0 AND 120, true) AS viable FROM records""", "records"),
    "location_table": """WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS short FROM benchmark),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_]+')) AS t,
  generate_subscripts(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_]+'), 1) AS pos FROM documents),
s AS (SELECT doc_id, string_agg(CASE WHEN short IS NULL THEN t ELSE upper(short) END, '' ORDER BY pos) AS text FROM w LEFT JOIN d ON lower(t) = short GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text = '' THEN '' ELSE s.text END AS text FROM documents d LEFT JOIN s USING (doc_id)""",
    "gender_table_conflicts": _with("""SELECT from_id, to_id FROM pairs JOIN g a ON a.name = lower(trim(from_given)) JOIN g b ON b.name = lower(trim(to_given))
  WHERE a.gender <> b.gender""", "pairs", "g"),
    "variant_table": _with("""SELECT record_id, CASE WHEN length(given_name) % 2 = 0 THEN reverse(lower(given_name)) ELSE given_name END AS variant
  FROM records""", "records"),
    "gender_conflicts": _with("""SELECT from_id, to_id, g_from AS from_gender, g_to AS to_gender
  FROM checked WHERE r4""", "checked"),
    "rule_penalty_totals": _with(f"""SELECT split_part(p, '=', 1) AS rule_name, count(*) AS pairs,
  sum(CAST(split_part(p, '=', 2) AS BIGINT)) AS points
  FROM (SELECT unnest({_POINTS}) AS p FROM checked) WHERE p IS NOT NULL GROUP BY 1""", "checked"),
    "rule_reasons": _with(f"""SELECT rule_name, triggered, CASE WHEN NOT triggered THEN 0
    WHEN rule_name IN ('physical_impossibility', 'biological_plausibility') THEN 50
    WHEN rule_name = 'AgeConsistencyRule' THEN CASE WHEN reason LIKE 'Implied%' THEN 50 ELSE 40 END
    WHEN rule_name = 'narrow_margin' THEN 15 ELSE 20 END AS penalty, reason, count(*) AS pairs
  FROM ({_REASONS}) GROUP BY ALL""", "checked"),
    "link_edges": _with(f"""SELECT from_id, to_id, {_TIER} AS tier,
  array_to_string([{_TIER}, CASE WHEN r3i OR r3c THEN 'age_conflict' END,
    CASE WHEN r4 THEN 'gender_conflict' END], '|') AS layers,
  CASE WHEN lower(from_given) = lower(to_given) THEN 'exact'
    WHEN (lower(from_given), lower(to_given)) IN (('john', 'jon'), ('jon', 'john')) THEN 'variant'
    WHEN list_cosine_similarity(a.embedding, b.embedding) >= 0.75 THEN 'similarity'
    ELSE 'family_only' END AS name_match,
  CASE WHEN NOT {_PLAUSIBLE} THEN 'no' WHEN {_SUM} > 0 THEN 'unlikely' ELSE 'yes' END AS verdict
  FROM checked LEFT JOIN vectors a ON a.record_id = from_id
  LEFT JOIN vectors b ON b.record_id = to_id""", "checked", "vectors"),
    "place_flows": _with(f"""SELECT from_location AS from_place, to_location AS to_place,
  {_TIER} AS tier, count(*) AS edges FROM checked GROUP BY 1, 2, 3""", "checked"),
    "match_exact": _with("""SELECT q.query_id, r.record_id, r.given_name, r.family_name, r.event_year, r.location,
  row_number() OVER (PARTITION BY q.query_id ORDER BY r.event_year ASC NULLS LAST, r.record_id) AS rank
  FROM queries q JOIN records r ON lower(r.family_name) = lower(q.family_name)
  AND (lower(r.given_name) = lower(q.given_name) OR (lower(r.given_name), lower(q.given_name))
    IN (('john', 'jon'), ('jon', 'john')))
  AND (q.approx_year IS NULL OR abs(r.event_year - q.approx_year) <= 2)
  AND (q.location IS NULL OR q.location = '' OR lower(r.location) = lower(q.location))
  QUALIFY rank <= 25""", "queries", "records"),
    "search_candidates": _with("SELECT * FROM found", "found"),
    "year_band_join": _with("""SELECT q.family_name, q.approx_year, q.queries, count(*) AS records
  FROM (SELECT family_name, approx_year, count(*) AS queries FROM queries GROUP BY 1, 2) q
  JOIN records r ON r.family_name = q.family_name AND abs(r.event_year - q.approx_year) <= 5
  GROUP BY 1, 2, 3""", "queries", "records"),
    "near_place_and_year": _with("SELECT * FROM near", "near"),
    "resolve": _with(_RESOLVE, "tops", "top_checked", "records"),
    "resolver_prompt": _with(_PROMPT, "found"),
    "rerank": _with("""SELECT query_id, record_id, rank, new_rank, round(sim, 4) AS similarity,
  rerank_applied FROM reranked""", "reranked"),
    "semantic_search": _with("""SELECT query_id, record_id, rank, round(sim, 4) AS score,
  left(given_name || ' ' || family_name || ', ' || event_year || coalesce(', ' || location, ''), 200) AS snippet,
  coalesce(location, '') AS location
  FROM (SELECT query_id, record_id, sim, row_number() OVER (
      PARTITION BY query_id ORDER BY round(sim, 10) DESC, record_id) AS rank
    FROM (SELECT query_id, record_id, list_cosine_similarity(query_vector, embedding) AS sim
      FROM query_vectors CROSS JOIN vectors) WHERE sim >= 0.2) JOIN records USING (record_id)
  WHERE rank <= 5""", "query_vectors", "vectors", "records"),
    "semantic_search_first_rows": _with("""SELECT query_id, record_id, rank, round(sim, 4) AS score
  FROM (SELECT query_id, record_id, sim, row_number() OVER (
      PARTITION BY query_id ORDER BY round(sim, 10) DESC, record_id) AS rank
    FROM (SELECT query_id, record_id, list_cosine_similarity(query_vector, embedding) AS sim
      FROM query_vectors CROSS JOIN (SELECT * FROM vectors JOIN records USING (record_id)
        ORDER BY event_year NULLS LAST, record_id LIMIT 20)) WHERE sim >= 0.1)
  WHERE rank <= 5""", "query_vectors", "vectors", "records"),
    "ann_recall": "SELECT 5 * (count(*) - 1) AS exact, true AS recall_ok FROM embeddings",
    "ann_scores": "SELECT count(*) - 1 AS queries, 5 AS most, true AS scores_true FROM embeddings",
    "ann_nearest_is_self":
    f"""SELECT a.vec_id AS query_id, min({_rid('b.vec_id')}) AS record_id, 1.0::DOUBLE AS score
  FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding GROUP BY a.vec_id""",
    "embedding_gaps": _with("""SELECT record_id FROM records WHERE record_id NOT IN
  (SELECT record_id FROM vectors)""", "records", "vectors"),
    "embed_hashing": """SELECT CAST(doc_id AS VARCHAR) AS record_id, 'hash-64' AS model_id, 64 AS dim,
  1.0::DOUBLE AS self FROM documents""",
    "ann_exact": _with("""SELECT query_id, record_id, rank, round(round(sim, 10), 3) AS score
  FROM (SELECT query_id, record_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 10) DESC, record_id) AS rank
    FROM (SELECT query_id, record_id, list_cosine_similarity(q, embedding) AS sim FROM (
      SELECT a.query_id, list_transform(list_zip(a.query_vector, b.query_vector), lambda z: (z[1] + 0.4::FLOAT * z[2])::FLOAT) AS q
      FROM query_vectors a JOIN query_vectors b ON b.query_id = a.query_id + 1) CROSS JOIN vectors))
  WHERE rank <= 5""", "query_vectors", "vectors"),
    "reindex": _with(f"""SELECT record_id, CASE WHEN changed THEN 'letters' ELSE 'test-64' END AS model_id,
  strftime(CASE WHEN changed THEN {AS_OF} ELSE TIMESTAMP '2001-01-01' END, '%Y-%m-%d %H:%M:%S') AS updated_at,
  CASE WHEN changed THEN {_letters('t')} ELSE {_elements('embedding')} END AS elements
  FROM (SELECT record_id, embedding, {_TEXT.format(year='event_year')} AS t, coalesce(created_at >= {AS_OF} OR updated_at >= {AS_OF}, false) AS changed
    FROM (SELECT coalesce(r.record_id, v.record_id) AS record_id, r.* EXCLUDE (record_id), v.embedding
      FROM records r FULL OUTER JOIN vectors v USING (record_id)))
  WHERE embedding IS NOT NULL OR changed""", "records", "vectors"),
    "reindex_report": _with(f"""SELECT count(*) AS records_processed, count(*) AS chunks_written,
  0::BIGINT AS error_count FROM records WHERE created_at >= {AS_OF} OR updated_at >= {AS_OF}""", "records"),
    "fill_gaps": _with(f"""SELECT record_id, 'test-64' AS model_id, {_elements('embedding')} AS elements FROM vectors
  UNION ALL SELECT record_id, 'letters', {_letters('t')} FROM (SELECT record_id, {_TEXT.format(year='event_year')} AS t FROM records)
  WHERE record_id NOT IN (SELECT record_id FROM vectors)""", "records", "vectors"),
    "ocr_fix": f"SELECT doc_id, {_OCR.format('text')} AS text FROM documents",
    "location_std": f"SELECT doc_id, {_place('text')} AS text FROM documents",
    "cleanse": f"SELECT doc_id, {_cleansed('text')} AS text FROM documents",
    "pii_redact": f"SELECT doc_id, {_redact('text')} AS text FROM documents",
    "title_case": f"""SELECT id, {_TITLE.format('name')} AS name FROM (
  SELECT 'P' || p_partkey AS id, p_name || '''' || p_type AS name FROM part
  UNION ALL SELECT c_name, c_mktsegment || '-' || c_name FROM customer)""",
    "embedding_text": _with(f"SELECT record_id, {_TEXT.format(year='event_year')} AS text FROM records", "records"),
    "record_text": _with(f"""SELECT record_id, CASE WHEN {_blank('text')} THEN {_TEXT.format(year='event_year')}
  ELSE {_cleansed('text')} END AS text FROM records LEFT JOIN documents ON doc_id = order_key""", "records"),
    "query_text": _with(f"""SELECT query_id, CASE WHEN {_blank('text')} THEN {_TEXT.format(year='approx_year')}
  ELSE text END AS text FROM queries LEFT JOIN documents ON doc_id = query_id""", "queries"),
    "name_facts": _with("""SELECT record_id, CASE given_name WHEN 'John' THEN 'jon' WHEN 'Jon' THEN 'john'
  ELSE given_name END AS variant, coalesce(gender, 'UNKNOWN') AS gender,
  left(given_name || ' ' || family_name || ', ' || event_year || coalesce(', ' || location, ''), 25) AS snippet
  FROM records LEFT JOIN genders ON name = lower(given_name)""", "records", "genders"),
    "validate_lines": _with("""SELECT source_key, source_line, array_to_string(reasons, '|') AS reasons,
  CASE WHEN j IS NULL THEN value END AS raw, record_id, given_name, family_name, event_year,
  birth_year, location FROM ruled""", "ruled"),
    "route_validated": _with(f"""SELECT record_id, given_name, family_name, CAST(event_year AS INTEGER) AS event_year,
  CAST(birth_year AS INTEGER) AS birth_year, location, NULL::VARCHAR AS source,
  {_redact('raw_content')} AS raw_content, compute_embedding, extra, source_key, source_line, 'b1' AS batch_id
  FROM kept WHERE len(reasons) = 0""", "kept"),
    "route_quarantine": _with("""SELECT source_key, source_line, 'b1' AS batch_id,
  array_to_string(reasons, '|') AS reasons, file_reason, CASE WHEN j IS NULL THEN value END AS raw
  FROM kept WHERE len(reasons) > 0""", "kept"),
    "validation_summary": _with("""SELECT source_key, count(*) AS ingress,
  count(*) FILTER (len(reasons) = 0) AS validated, count(*) FILTER (len(reasons) > 0) AS quarantined
  FROM ruled GROUP BY 1""", "ruled"),
    "file_verdicts": _with("""SELECT source_key, count(*) AS ingress, count(j) AS json_ok,
  CASE WHEN count(j) = 0 THEN 'no valid JSON lines' END AS file_reason FROM ruled GROUP BY 1
  UNION ALL SELECT 'landing/region-' || r_regionkey || '.ndjson', 0, 0, 'empty file' FROM region""", "ruled"),
    "quarantine_manifest": _with("""SELECT replace(k.source_key, 'landing/', 'quarantine/') AS quarantine_key,
  k.source_key, 'b1' AS batch_id, line_count, reasons, 'pending' AS replay_status
  FROM (SELECT source_key, count(*) AS line_count FROM kept WHERE len(reasons) > 0 GROUP BY 1) k
  JOIN (SELECT source_key, string_agg(reason, '|' ORDER BY first_line, first_pos, reason) AS reasons
    FROM seen GROUP BY 1) s USING (source_key)
  UNION ALL SELECT 'quarantine/region-' || r_regionkey || '.ndjson', 'landing/region-' || r_regionkey || '.ndjson', 'b1', 0, 'empty file', 'pending'
  FROM region""", "kept", "seen"),
    "quarantine_reasons": _with("""SELECT source_key, reason, lines, first_line,
  CAST(first_pos AS INTEGER) AS first_pos FROM seen""", "seen"),
    "replay": _with("""SELECT replace(source_key, 'landing/', 'quarantine/') AS source_key, source_line,
  CASE WHEN j IS NULL THEN 'failed' WHEN coalesce(record_id, '') = '' OR coalesce(given_name, '') = ''
    OR coalesce(family_name, '') = '' THEN 'skipped' ELSE 'ok' END AS outcome
  FROM kept WHERE len(reasons) > 0""", "kept"),
    "ingest_summary": _with("""SELECT source_key, count(*) AS total, count(*) FILTER (o = 'ok') AS ok,
  count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed,
  coalesce(array_to_string(list_transform(list_sort(list(source_line) FILTER (o = 'failed'))[1:20],
    lambda n: 'line ' || n || ': invalid JSON'), '|'), '') AS errors
  FROM (SELECT *, CASE WHEN j IS NULL THEN 'failed' WHEN coalesce(record_id, '') = ''
    OR coalesce(family_name, '') = '' THEN 'skipped' ELSE 'ok' END AS o FROM parsed) GROUP BY 1""", "parsed"),
    "manifest_update": _with("""SELECT replace(source_key, 'landing/', 'quarantine/') AS quarantine_key,
  CASE WHEN failed = 0 THEN 'replayed' ELSE 'partial' END AS replay_status, 1 AS replays, ok, failed,
  CAST(least(failed, 10) AS INTEGER) AS errors FROM (
    SELECT source_key, count(*) FILTER (j IS NULL) AS failed,
      count(*) FILTER (j IS NOT NULL AND record_id IS NOT NULL AND family_name IS NOT NULL) AS ok
    FROM kept WHERE len(reasons) > 0 GROUP BY 1)""", "kept"),
    "ingest_defaults_applied": _with("""SELECT record_id, 'ingest-api' AS source,
  coalesce(compute_embedding, true) AS compute_embedding,
  replace(source_key, 'landing/', 'validated/') AS key FROM kept WHERE len(reasons) = 0""", "kept"),
    "assign_chunks": _with("""SELECT source_key, replace(source_key, '.ndjson', '') || '-chunk-'
  || lpad(CAST((source_line - 1) // 200 + 1 AS VARCHAR), 3, '0') || '.ndjson' AS chunk_key,
  count(*) AS lines, min(source_line) AS first_line FROM landing GROUP BY 1, 2""", "landing"),
    "oversize_files": _with("""SELECT source_key, count(*) AS lines FROM landing GROUP BY 1
  HAVING count(*) > 200""", "landing"),
    "replay_duplicates": _with("""SELECT source_key, source_line, 2::BIGINT AS batches
  FROM kept WHERE len(reasons) > 0""", "kept"),
    "pair_outputs": _with("""SELECT source_key, source_line, 1::BIGINT AS lines, 0::BIGINT AS copies
  FROM ruled WHERE len(reasons) = 0 AND source_line % 50 = 0""", "ruled"),
    "ingest_errors": _with("SELECT source_key, source_line, 'invalid JSON' AS error FROM parsed WHERE j IS NULL", "parsed"),
    "upsert_records": _with(_UPSERTED, "records", "latest"),
    "upsert_embeddings": f"""SELECT coalesce(n.id, o.id) AS record_id,
  CASE WHEN n.id IS NOT NULL THEN 'v2' ELSE 'test-64' END AS model_id,
  CASE WHEN n.id IS NOT NULL THEN '2000-01-01 00:00:00' ELSE '2001-01-01 00:00:00' END AS updated_at,
  CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END AS elements
  FROM (SELECT {_rid('vec_id')} AS id, {_elements('embedding')} AS v FROM embeddings) o
  FULL OUTER JOIN (SELECT {_rid('vec_id + 100')} AS id, {_elements('embedding')} AS v FROM embeddings) n
  ON o.id = n.id""",
    "insert_if_absent": _with(f"""SELECT record_id, given_name, family_name, event_year, location, source,
  {_day('created_at')} FROM records
  UNION ALL SELECT record_id, given_name, family_name, event_year, location, source, NULL FROM earliest
  WHERE record_id NOT IN (SELECT record_id FROM records)""", "records", "earliest"),
    "list_records": _with("""SELECT record_id, given_name, family_name, event_year, location, birth_year
  FROM records ORDER BY record_id""", "records"),
    "count_records": _with("SELECT count(*) AS total FROM records", "records"),
    "changed_since": _with(f"""SELECT record_id, {_day('created_at')}, {_day('updated_at')} FROM records
  WHERE created_at >= {AS_OF} OR updated_at >= {AS_OF}""", "records"),
    "archive_plan": _with("""SELECT (SELECT count(*) FROM archived) AS eligible,
  (SELECT string_agg(record_id, '|' ORDER BY record_id) FROM
    (SELECT record_id FROM archived ORDER BY 1 LIMIT 5)) AS sample_ids""", "archived"),
    "archive_prune": _with("""SELECT record_id, 'record' AS kind FROM records
  WHERE record_id NOT IN (SELECT record_id FROM archived)
  UNION ALL SELECT record_id, 'embedding' FROM vectors
  WHERE record_id NOT IN (SELECT record_id FROM archived)""", "records", "archived", "vectors"),
    "archive_export": _with("""SELECT 365 AS retention_days, (SELECT count(*) FROM archived) AS record_count,
  (SELECT count(*) FROM vectors WHERE record_id IN (SELECT record_id FROM archived)) AS embedding_count,
  'records/2000-01-01' AS prefix""", "archived", "vectors"),
    "read_archive": _with(f"""SELECT record_id, given_name, family_name, event_year, birth_year, location,
  source, {_day('created_at')} FROM archived""", "archived"),
    "archive_by_family": _with("""SELECT record_id, given_name, family_name, event_year, location
  FROM archived WHERE lower(family_name) = 'bramley'""", "archived"),
    "archive_counts": _with("SELECT source, count(*) AS total FROM archived GROUP BY 1", "archived"),
    "archive_with_embeddings": _with("""SELECT record_id, given_name, family_name FROM archived
  JOIN vectors USING (record_id)""", "archived", "vectors"),
    "neighborhood_snapshot": _with(_SNAP, "requests", "near"),
    "top_names": _with("""SELECT location, given_name || ' ' || family_name AS name, count(*) AS n,
  row_number() OVER (PARTITION BY location ORDER BY count(*) DESC, given_name || ' ' || family_name) AS rank
  FROM records GROUP BY 1, 2 QUALIFY rank <= 5""", "records"),
    "ingest_rate": _with(f"""SELECT strftime({_bucket('1 minute')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS records, count(*)::DOUBLE AS rate_per_min FROM ev GROUP BY 1""", "ev"),
    "ingest_health": _with(f"""SELECT (SELECT count(*) FROM records WHERE record_id NOT IN
    (SELECT record_id FROM vectors)) AS embedding_gap_count, 1 AS last_batch_size,
  (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM ev WHERE ts <= TIMESTAMP '2024-01-15') AS last_batch_at,
  (SELECT count(*)::DOUBLE FROM ev WHERE ts < TIMESTAMP '2024-01-15' GROUP BY {_bucket('1 minute')}
    ORDER BY {_bucket('1 minute')} DESC LIMIT 1) AS ingest_rate_per_min, 'ok' AS status""",
                           "records", "vectors", "ev"),
    "month_to_date": """SELECT 'OK' AS status, 'flag=A' AS tag_filter_summary,
  CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS VARCHAR) AS amount_usd,
  '2000-03-01' AS period_start, '2000-04-01' AS period_end_exclusive FROM lineitem
  WHERE l_returnflag = 'A' AND l_shipdate >= DATE '2000-03-01' AND l_shipdate < DATE '2000-04-01'""",
    "dq_unique": _with("SELECT record_id, count(*) AS n FROM arrivals GROUP BY 1 HAVING n > 1", "arrivals"),
    "dq_birth_before_event": _with("""SELECT record_id, birth_year, event_year FROM records
  WHERE birth_year >= event_year""", "records"),
    "dq_age_range": _with("""SELECT record_id, event_year - birth_year AS age FROM records
  WHERE event_year - birth_year NOT BETWEEN 1 AND 110""", "records"),
    "dq_embedding_dim": """SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing,
  count(*) FILTER (len(embedding) <> 64) AS wrong_dim, 0::BIGINT AS with_nulls FROM embeddings""",
    "dq_required_ids": _with("""SELECT DISTINCT record_id FROM arrivals
  WHERE record_id NOT IN (SELECT record_id FROM records)""", "arrivals", "records"),
    "dq_count_prefix": _with("SELECT count(*) AS n FROM arrivals WHERE record_id LIKE 'R-1000%'", "arrivals"),
    "read_landing": _with("""SELECT replace(source_key, 'landing/', '') AS file,
  row_number() OVER (PARTITION BY source_key ORDER BY source_line) AS source_line, value FROM landing""", "landing"),
    "landing_files": _with("""SELECT replace(source_key, 'landing/', '') AS file, 1::BIGINT AS files,
  sum(strlen(value) + 1)::BIGINT AS bytes FROM landing GROUP BY 1""", "landing"),
    "contains_ci": _with("""SELECT given_name, count(*) FILTER (family_name ILIKE '%ford%') AS plain, 0::BIGINT AS literal,
  count(*) FILTER (family_name ILIKE '%b%wi_k%') AS wild FROM records GROUP BY 1""", "records"),
    "registered_cleanser": f"""SELECT doc_id, CASE WHEN {_blank('text')} THEN text
  ELSE replace({_place(_OCR.format('text'))}, 'the', 'THE') END AS text FROM documents""",
    "registered_rule": _with("""SELECT from_year, count(*) FILTER (to_year - from_year >= 5) AS fired, count(*) AS pairs,
  (3 * nullif(count(*) FILTER (to_year - from_year >= 5), 0))::BIGINT AS points FROM pairs GROUP BY 1""", "pairs"),
    "own_embedder": _with(f"""SELECT record_id, length({_TEXT.format(year='event_year')}) AS n, 2 AS dim FROM records""", "records"),
    "own_dimensions": _with("""SELECT CASE WHEN lower(from_given) = lower(to_given) THEN 'exact'
    WHEN (lower(from_given), lower(to_given)) IN (('ruth', 'leslie'), ('leslie', 'ruth')) THEN 'variant'
    ELSE 'family_only' END AS name_match, count(*) AS edges,
  count(*) FILTER ((lower(from_given), lower(to_given)) IN (('zxqvr', 'john'), ('john', 'zxqvr'))) AS conflicts
  FROM pairs GROUP BY 1""", "pairs"),
    "stream_late_data": _with(f"""SELECT strftime({_bucket('1 day')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  sum(ingress)::BIGINT AS ingress, sum(quarantined)::BIGINT AS quarantined, true AS dropped FROM ev GROUP BY 1""", "ev"),
    "stream_quarantine_spike": _with(f"""SELECT strftime({_bucket('1 day')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  sum(quarantined)::BIGINT AS quarantined FROM ev GROUP BY 1 HAVING sum(quarantined) > 50""", "ev"),
    "stream_ingress": _with(f"""SELECT strftime({_bucket('5 minutes')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  sum(ingress)::BIGINT AS ingress, sum(quarantined)::BIGINT AS quarantined,
  round(sum(quarantined) / sum(ingress), 4) AS rate FROM ev GROUP BY 1""", "ev"),
    "stream_rate": _with(f"""SELECT strftime({_bucket('1 minute')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS records, count(*)::DOUBLE AS rate_per_min FROM ev GROUP BY 1""", "ev"),
    "stream_errors": _with(f"""SELECT strftime({_bucket('5 minutes')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  sum(quarantined)::BIGINT AS errors FROM ev GROUP BY 1 HAVING sum(quarantined) > 0""", "ev"),
    "stream_latency": _with(f"""SELECT strftime({_bucket('5 minutes')}, '%Y-%m-%d %H:%M:%S') AS window_start,
  round(quantile_disc(latency_ms, 0.5), 4) AS p50, round(quantile_disc(latency_ms, 0.99), 4) AS p99,
  quantile_disc(latency_ms, 0.99) > 5000 AS alarm FROM ev GROUP BY {_bucket('5 minutes')}""", "ev"),
    "stream_gap_alarm": _with(f"""SELECT strftime(b + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end
  FROM (SELECT b, lag(b) OVER (ORDER BY b) AS p FROM (SELECT {_bucket('15 minutes')} AS b FROM ev
    GROUP BY 1 HAVING max(quarantined) > 0)) WHERE p = b - INTERVAL 15 MINUTE""", "ev"),
    "stream_dedupe": _with(f"SELECT batch_id, {_day('ts')} FROM ev", "ev"),
    "kept_counts": _with(f"""SELECT lower(location) AS l, event_year AS y, concat_ws(' ', given_name, family_name) AS name, count(*) AS n
  FROM ({_UPSERTED}) WHERE event_year IS NOT NULL AND NOT coalesce(strptime(created_at, '%Y-%m-%d %H:%M:%S') < {AS_OF} - INTERVAL 365 DAY, false)
  GROUP BY ALL""", "records", "latest"),
    "metered_lines": _with("""SELECT source_key, count(*) FILTER (len(reasons) = 0) AS lines, sum(count(*) FILTER (len(reasons) = 0)) OVER ()::BIGINT AS validated,
  sum(count(*) FILTER (len(reasons) > 0)) OVER ()::BIGINT AS quarantined FROM ruled GROUP BY 1 QUALIFY lines > 0""", "ruled"),
    "stream_first_arrivals": _with(f"SELECT batch_id, {_day('ts')}, 'monday' AS run_of FROM ev", "ev"),
    "stream_gap_runs": _with("""SELECT monitor, strftime(b + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, length FROM (
  SELECT *, row_number() OVER (PARTITION BY monitor, start ORDER BY b) AS length FROM (
    SELECT *, b - to_hours(row_number() OVER (PARTITION BY monitor ORDER BY b)) AS start FROM (
      SELECT batch_id % 3 AS monitor, date_trunc('hour', ts) AS b FROM ev GROUP BY ALL HAVING max(quarantined) > 0)))
  WHERE length >= 3""", "ev"),
    "latency_sketches": _with(f"""SELECT strftime({_bucket('1 day')}, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, count(*) AS counted,
  true AS median_near, true AS high_near FROM ev GROUP BY 1""", "ev"),
    "stream_validate": _with(f"""SELECT record_id, given_name, family_name, CAST(event_year AS INTEGER) AS event_year,
  CAST(birth_year AS INTEGER) AS birth_year, location, {_redact('raw_content')} AS raw_content, compute_embedding, extra,
  NULL::VARCHAR AS reasons, NULL::VARCHAR AS raw FROM ruled WHERE len(reasons) = 0
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, array_to_string(reasons, '|'), CASE WHEN j IS NULL THEN value END
  FROM ruled WHERE len(reasons) > 0""", "ruled"),
    "stream_upsert": _with(_UPSERTED, "records", "latest"),
    "stream_embed": f"""SELECT CAST(doc_id AS VARCHAR) AS record_id, 'letters' AS model_id, {_letters('t')} AS elements
  FROM (SELECT doc_id, CASE WHEN {_blank('text')} THEN 'givenName= familyName=' ELSE {_cleansed('text')} END AS t FROM documents)""",
}
