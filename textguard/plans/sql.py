"""SQL of the registered queries: profile texts for both engines, and DuckDB counterparts.

The counterparts reach the same rows by other means: spans of documents by splitting or, where
a pattern looks around itself, by trying every start; spans of profiles from their
construction; digests and draws from DuckDB's own hash functions.
"""

from __future__ import annotations

from textguard.operators.pseudonym import FIRM, FIRST, LAST, STREET, hmac_pads
from textguard.schema import CATEGORIES, PRIORITY, Settings

RESOLVER_CATEGORIES = ("EMAIL", "NAME", "ADDRESS", "PHONE", "COMPANY", "OTHER", "IP")


def _case(key: str, words) -> str:
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END"


_FIRST = _case("k", ("Asha", "Ravi", "Meera", "Kiran", "Sunil"))
_MIDDLE = _case("k", ("Mohan", "Devi", "Prakash"))
_LAST = _case("k", ("Rao", "Sharma", "Kapoor", "Desai", "Khan", "Jain", "Verma"))
# persons of the other anchors, whose names nobody else has
_GUEST = _case("k", ("Nikhil", "Pooja", "Tarun"))
_FAMILY = [_case("k", x) for x in (("Bhatt", "Mistry"), ("Saxena", "Dalal"), ("Pandit", "Ghosh"), ("Sinha", "Biswas"))]
_MONTH = _case("k", ("January", "March", "May", "August", "December"))
_FIRM = _case("k", ("Blue Lake Wealth", "Cotton Mills and Power", "Sunrise Tools (India)"))
_SUFFIX = _case("k", ("Limited", "Private Limited", "LLP", "Ltd."))


def _pad(expression: str, n: int) -> str:
    return f"lpad(cast({expression} as string), {n}, '0')"


#: (prefix, value, suffix, category of the value or null, skip when this holds); k is the customer's key.
_TEMPLATES = (
    ("'Holder ' || k || ' has SSN '", f"{_pad('k % 900 + 100', 3)} || '-' || {_pad('k % 100', 2)} || '-' || {_pad('k % 10000', 4)}", "'.'", "SSN"),
    ("'Short ' || k || ' form 12-345-6789 and 1234-56-7890 '", "''", "'stay'", None),
    ("'Date of birth: '", f"{_MONTH} || ' ' || {_pad('k % 28 + 1', 2)} || ', ' || (1950 + k % 50)", "' as filed'", "DOB"),
    ("'was born on '", f"{_pad('k % 28 + 1', 2)} || '/' || {_pad('k % 12 + 1', 2)} || '/' || (1950 + k % 50)", "' in town'", "DOB"),
    ("'founded on July 30, 1979 and moved on 12/05/1980, page 269'", "''", "' only'", None),
    ("'Contact Person: '", f"{_FIRST} || ' ' || {_MIDDLE} || ' ' || {_LAST}", "' signed'", "NAME"),
    ("'later '", f"{_FIRST} || ' ' || {_LAST}", "' spoke again'", "NAME"),
    ("'appointed '", f"{_FIRM} || ' ' || {_SUFFIX}", "' as lead'", "COMPANY"),
    ("'the Company Promoter '", f"{_FIRM} || ' ' || {_SUFFIX}", "' signed'", "COMPANY"),
    ("'listed on BSE Limited, the Private Limited form '", "''", "'too'", None),
    ("'held by '", f"{_LAST} || ' Family Trust'", "' since'", "COMPANY"),
    ("'at '", f"'B' || (k % 90 + 1) || ', Sample Society, Test Road, Pune – 411 ' || {_pad('k % 1000', 3)}", "', India'", "ADDRESS"),
    ("'situated at '", f"'Plot 5, Test Road, 98765' || {_pad('k % 100000', 5)} || ' near Pune 411 ' || {_pad('k % 1000', 3)}", "' India'", "ADDRESS"),
    ("'near '", f"'Pune – 411 ' || {_pad('k % 1000', 3)}", "' only'", "ADDRESS"),
    ("'call '", f"'+91 98765 ' || {_pad('k % 100000', 5)}", "' today'", "PHONE"),
    ("'dial '", f"'022-5550' || {_pad('k % 10000', 4)}", "', please'", "PHONE"),
    ("'paid Rs98765' || k % 10 || '3210 and 26,704,570 shares of 7,100.00 million, DIN 00' || k || '00, ₹9876543210, 9876543210 crore'", "''", "' due'", None),
    ("'write to '", "'user' || k || '.x@mail' || k % 7 || '.example.org'", "' or call'", "EMAIL"),
    ("'card '", _case("k", ("4111 1111 1111 1111", "5555-5555-5555-4444", "378282246310005")), "' ok'", "CREDIT_CARD"),
    ("'card 4111111111111112 and host 999.1.1.1 fail, page '", "''", "'none'", None),
    ("'host '", "(k % 223 + 1) || '.' || k % 256 || '.0.' || k % 256", "' up'", "IP"),
    ("'with Smt. '", f"{_GUEST} || ' ' || {_FAMILY[0]}", "' and others'", "NAME"),
    ("'here '", f"{_GUEST} || ' ' || {_FAMILY[1]}", "' is our adviser'", "NAME"),
    ("'the heir being '", f"{_GUEST} || ' ' || {_FAMILY[2]}", "' as agreed'", "NAME"),
    ("'in charge is the Contact Person:'", "''", "''", None),
    ("''", f"{_GUEST} || ' ' || {_FAMILY[3]}", "' replied'", "NAME"),
    ("'no anchor for Gita Prabhu'", "''", "' at all'", None),
)


def _profile_rows() -> str:
    parts = []
    for n, (pre, val, post, category) in enumerate(_TEMPLATES):
        tag = "cast(null as string)" if category is None else f"'{category}'"
        parts.append(f"SELECT cast(k as string) AS doc_id, {n} AS ordinal, {pre} AS pre, {val} AS val, {post} AS post, {tag} AS category FROM c")
    return "\nUNION ALL\n".join(parts)


_BODY = f"WITH c AS (SELECT c_custkey AS k FROM {{customer}})\n{_profile_rows()}"
PROFILES = _BODY
_PROFILES_DUCK = _BODY.format(customer="customer")


def _constructed(category: str) -> str:
    return f"SELECT doc_id, ordinal, length(pre)::INTEGER AS span_start, length(pre || val)::INTEGER AS span_end, val AS value FROM ({_PROFILES_DUCK}) WHERE category = '{category}'"


_PROFILE_SPANS = f"SELECT doc_id, ordinal, length(pre)::INTEGER AS span_start, length(pre || val)::INTEGER AS span_end, val AS value, category FROM ({_PROFILES_DUCK}) WHERE category IS NOT NULL"

_DIGITS = r"regexp_replace({0}, '[^0-9]', '', 'g')"


def _split_spans(pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Matches with offsets: pieces between them, and running lengths."""
    return f"""
    SELECT doc_id, text, v AS value, (sum(length(g) + length(v)) OVER w - length(v))::INTEGER AS span_start, (sum(length(g) + length(v)) OVER w)::INTEGER AS span_end
    FROM (SELECT {key}::VARCHAR AS doc_id, {text} AS text, unnest(regexp_extract_all({text}, '{pattern}')) AS v,
                 unnest(string_split_regex({text}, '{pattern}')[:len(regexp_extract_all({text}, '{pattern}'))]) AS g,
                 unnest(range(len(regexp_extract_all({text}, '{pattern}')))) AS i
          FROM {table} WHERE regexp_matches({text}, '{pattern}'))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def _email(*of: str) -> str:
    return f"SELECT doc_id, span_start, span_end, value FROM ({_split_spans('[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', *of)})"


def _ip(*of: str) -> str:
    return f"SELECT doc_id, span_start, span_end, value FROM ({_split_spans(r'\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\b', *of)}) WHERE list_max(list_transform(string_split(value, '.'), lambda o: o::INTEGER)) <= 255"


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INTEGER ELSE (substr(d, length(d) - i + 1, 1)::INTEGER * 2) - CASE WHEN substr(d, length(d) - i + 1, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


def _card(*of: str) -> str:
    return f"""SELECT doc_id, span_start, (span_start + length(rtrim(value, ' -')))::INTEGER AS span_end, rtrim(value, ' -') AS value
FROM (SELECT *, {_DIGITS.format('value')} AS d FROM ({_split_spans(r'\b(?:[0-9][ -]?){13,16}\b', *of)})) WHERE length(d) BETWEEN 13 AND 16 AND {_LUHN}"""


def _phone(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return rf"""
SELECT doc_id, (s + length(v) - length(ltrim(v, ' -')))::INTEGER AS span_start, (s + length(rtrim(v, ' -')))::INTEGER AS span_end, trim(v, ' -') AS value
FROM (SELECT *, {_DIGITS.format('v')} AS d, lower(substr(text, greatest(s - 1, 1)::INTEGER, least(s, 2)::INTEGER)) AS before, lower(substr(text, e + 1, 12)) AS after FROM (
  WITH RECURSIVE starts AS MATERIALIZED (
    SELECT doc_id, text, p - 1 AS s, regexp_extract(substr(text, p, 80), '^((?:\+\s?)?(?:91[\s-]?|0)?(?:\(?[0-9]{{2,5}}\)?[\s-]?)?[0-9]{{3,5}}[\s-]?[0-9]{{3,6}})(?:[^0-9]|$)', 1) AS v
    FROM (SELECT {key}::VARCHAR AS doc_id, {text} AS text, unnest(range(1, length({text}) + 1)) AS p FROM {table} WHERE regexp_matches({text}, '[0-9]{{3}}'))
    WHERE substr(text, p, 1) IN ('+', '(', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') AND (p = 1 OR NOT regexp_matches(substr(text, p - 1, 1), '[0-9,.]'))),
  found AS MATERIALIZED (SELECT doc_id, text, s, v, s + length(v) AS e FROM starts WHERE v <> ''),
  chain AS (
    SELECT doc_id, min(s) AS s, arg_min(e, s) AS e, arg_min(v, s) AS v, any_value(text) AS text FROM found GROUP BY doc_id
    UNION ALL
    SELECT c.doc_id, min(f.s), arg_min(f.e, f.s), arg_min(f.v, f.s), any_value(f.text) FROM chain c JOIN found f ON f.doc_id = c.doc_id AND f.s >= c.e GROUP BY c.doc_id)
  SELECT * FROM chain))
WHERE length(d) BETWEEN 10 AND 13 AND NOT contains(before, '₹') AND NOT contains(before, 'rs') AND NOT regexp_matches(after, '^\s*(million|billion|crore|lakh|%|per cent)')
  AND ((length(d) = 10 AND regexp_matches(d, '^[6-9]')) OR (starts_with(d, '91') AND length(d) IN (11, 12)) OR starts_with(trim(v), '+') OR (regexp_matches(v, '[- ]') AND length(d) IN (10, 11)))
"""


def _structured(*of: str) -> str:
    """Spans of all structured categories; of different ones they may overlap."""
    return " UNION ALL ".join(f"SELECT doc_id, span_start, span_end, value, '{c}' AS category FROM ({q(*of)})" for c, q in (("EMAIL", _email), ("PHONE", _phone), ("CREDIT_CARD", _card), ("IP", _ip)))


_DOCUMENT_SPANS = _structured()
# Structured categories share one priority: of overlapping spans the longest stays, then the first, then the first detector's.
_PAGE_SPANS = f"""
WITH RECURSIVE spans AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start - span_end, span_start, list_position(['EMAIL', 'PHONE', 'CREDIT_CARD', 'IP'], category)) AS r
  FROM ({_structured("pages", "page_id", "html")})),
fold AS (
  SELECT doc_id, 0::BIGINT AS r, []::STRUCT(span_start INTEGER, span_end INTEGER, value VARCHAR, category VARCHAR)[] AS kept FROM (SELECT DISTINCT doc_id FROM spans)
  UNION ALL
  SELECT f.doc_id, x.r, CASE WHEN len(list_filter(f.kept, lambda k: k.span_start < x.span_end AND x.span_start < k.span_end)) > 0 THEN f.kept
                             ELSE list_append(f.kept, {{'span_start': x.span_start, 'span_end': x.span_end, 'value': x.value, 'category': x.category}}) END
  FROM fold f JOIN spans x ON x.doc_id = f.doc_id AND x.r = f.r + 1)
SELECT doc_id, k.span_start AS span_start, k.span_end AS span_end, k.value AS value, k.category AS category
FROM (SELECT doc_id, unnest(kept) AS k FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM fold GROUP BY doc_id))"""


def _normal(category: str, value: str) -> str:
    spaced = f"lower(trim(regexp_replace({value}, '\\s+', ' ', 'g')))"
    return f"CASE WHEN {category} = 'EMAIL' THEN lower({value}) WHEN {category} = 'PHONE' THEN {_DIGITS.format(value)} WHEN {category} IN ('NAME', 'COMPANY', 'ADDRESS') THEN {spaced} ELSE {value} END"


def _digest(category: str, value: str, salt: str) -> str:
    inner, outer = hmac_pads(salt)
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({category} || ':' || {_normal(category, value)})))), 1, 16)"


def _draw(label: str, n: int) -> str:
    return f"(('0x' || substr(sha256(h || ':{label}'), 1, 8))::BIGINT % {n})"


def _pick(label: str, words) -> str:
    return f"list_extract([{', '.join(repr(w) for w in words)}], ({_draw(label, len(words))} + 1)::INTEGER)"


def _figures(label: str, n: str) -> str:
    x = f"translate(sha256(h || ':{label}'), 'abcdef', '123456')"
    return f"substr(replace(substr({x}, 1, 1), '0', '7') || substr({x}, 2), 1, {n})"


def _reshape(template: str, number: str) -> str:
    before = f"length({_DIGITS.format(f'substr({template}, 1, i)')})"
    chars = f"list_transform(range(1, length({template}) + 1), lambda i: CASE WHEN regexp_matches(substr({template}, i, 1), '[0-9]') THEN substr({number}, {before}, 1) ELSE substr({template}, i, 1) END)"
    return f"(array_to_string({chars}, '') || substr({number}, length({_DIGITS.format(template)}) + 1))"


_BODY_FIGURES = _figures("a", f"length({_DIGITS.format('t')}) - 1")
_CHECK = f"(10 - list_sum(list_transform(range(1, length(b) + 1), lambda i: CASE WHEN i % 2 = 0 THEN substr(b, length(b) - i + 1, 1)::INTEGER ELSE substr(b, length(b) - i + 1, 1)::INTEGER * 2 - CASE WHEN substr(b, length(b) - i + 1, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10) % 10"
_TEN = f"(list_extract(['6', '7', '8', '9'], ({_draw('a', 4)} + 1)::INTEGER) || {_figures('b', '9')})"
_NAMES = "[" + ", ".join([_pick("f", FIRST), *(_pick(f"l{k}", LAST) for k in range(4))]) + "]"
_KEPT = "(Limited|Ltd[.]?|LLP|Securities|Capital|Advisors|Bank|Ventures|Partners|Technologies|Industries|Financial Services)$"


def _replacement(anchor: str) -> str:
    """From columns category, t (template), h (digest) and b (card body)."""
    n = f"length({_DIGITS.format('t')})"
    firm = f"{_pick('w', FIRM)} || ' ' || CASE WHEN regexp_extract(t, '{_KEPT}', 1) = '' THEN 'Limited' ELSE regexp_extract(t, '{_KEPT}', 1) END"
    return f"""CASE category
      WHEN 'EMAIL' THEN lower({_pick('f', FIRST)}) || '.' || lower({_pick('l0', LAST)}) || '@example.com'
      WHEN 'PHONE' THEN CASE WHEN starts_with(trim(t), '+91') OR starts_with({_DIGITS.format('t')}, '91') THEN '+91 ' || ({_draw('a', 30000)} + 70000) || ' ' || ({_draw('b', 90000)} + 10000)
                             WHEN {n} = 10 THEN {_reshape('t', _TEN)} ELSE {_reshape('t', _figures('a', n))} END
      WHEN 'SSN' THEN ({_draw('a', 800)} + 100) || '-' || ({_draw('b', 90)} + 10) || '-' || ({_draw('c', 9000)} + 1000)
      WHEN 'CREDIT_CARD' THEN {_reshape('t', f'(b || ({_CHECK})::VARCHAR)')}
      WHEN 'IP' THEN {" || '.' || ".join(f"({_draw(x, 254)} + 1)" for x in "abcd")}
      WHEN 'DOB' THEN strftime(DATE '{anchor}' - ({_draw('a', 50 * 365)} + {25 * 366})::INTEGER, '%B %d, %Y')
      WHEN 'NAME' THEN array_to_string(list_slice({_NAMES}, 1, greatest(1, len(string_split(trim(t), ' ')))), ' ')
      WHEN 'COMPANY' THEN CASE WHEN lower(t) LIKE '%family trust' THEN {_pick('l0', LAST)} || ' Family Trust' ELSE {firm} END
      WHEN 'ADDRESS' THEN ({_draw('n', 998)} + 1) || ', ' || {_pick('s', STREET)} || ' – ' || ({_draw('p', 900_000)} + 100000)
      ELSE '[REDACTED]' END"""


def _mapped(spans: str, settings: Settings) -> str:
    """Spans with digest h, first-seen template t and replacement; ``spans`` has doc_id, ordinal, span_start."""
    return f"""
    SELECT *, {_replacement(settings.anchor_date)} AS replacement FROM (
      SELECT *, {_BODY_FIGURES} AS b FROM (
        SELECT *, first_value(value) OVER (PARTITION BY h, category ORDER BY doc_id, ordinal, span_start) AS t FROM (
          SELECT *, {_digest('category', 'value', settings.salt)} AS h FROM ({spans}))))"""


_PERSONS = f"""
SELECT DISTINCT doc_id, person FROM (
  SELECT cast(k as string) AS doc_id, unnest([{_FIRST} || ' ' || {_MIDDLE} || ' ' || {_LAST}, {_FIRST} || ' ' || {_LAST}, {", ".join(f"{_GUEST} || ' ' || {x}" for x in _FAMILY)}]) AS person FROM (SELECT c_custkey AS k FROM customer))"""

#: Cells of two tables a document; the second names no role, so nobody is mined from it.
_CELL = "SELECT cast(k as string) AS doc_id, {0} AS ordinal, {1} AS table_id, {2} AS row, {3} AS col, {4} AS text FROM c"
CELLS = "WITH c AS (SELECT c_custkey AS k FROM {customer})\n" + "\nUNION ALL\n".join(
    _CELL.format(*x)
    for x in (
        (0, 0, 0, 0, "'Sr. No.'"), (1, 0, 0, 1, "'Name of the holder'"), (2, 0, 0, 2, "'Designation'"),
        (3, 0, 1, 0, "'1'"), (4, 0, 1, 1, f"{_FIRST} || ' ' || {_MIDDLE} || '  ' || {_LAST} || '*(1)'"), (5, 0, 1, 2, "'Member'"),
        (6, 0, 2, 0, "'2'"), (7, 0, 2, 1, "'Total'"), (8, 0, 2, 2, "''"), (9, 0, 3, 1, f"'the ' || {_GUEST} || ' ' || {_FAMILY[0]} || ' family'"),
        (10, 1, 0, 0, "'Name'"), (11, 1, 0, 1, "'Age'"), (12, 1, 1, 0, "'Gita Prabhu'"), (13, 1, 1, 1, "'40'"),
    )
)
_MINED = f"""
SELECT DISTINCT doc_id, person FROM (
  SELECT cast(k as string) AS doc_id, unnest([{_FIRST} || ' ' || {_MIDDLE} || ' ' || {_LAST}, {_FIRST} || ' ' || {_LAST}, {_GUEST} || ' ' || {_FAMILY[0]}]) AS person FROM (SELECT c_custkey AS k FROM customer))"""

# Units of a file: its heading, a table with a header row and a row a text, the texts, a header and a footer.
_DOCX = """
WITH d AS (SELECT s_nationkey::VARCHAR AS doc_id, list_sort(list(s_name)) AS t, count(*)::INTEGER AS n FROM supplier GROUP BY s_nationkey),
e AS (SELECT doc_id, t, n, unnest(range(1, n + 1))::INTEGER AS r FROM d),
u AS (
  SELECT doc_id, 0 AS ordinal, 'body' AS kind, 'word/document.xml' AS part, 'body/0' AS xml_path, NULL::INTEGER AS table_id, NULL::INTEGER AS row, NULL::INTEGER AS col, 'Region ' || doc_id AS text FROM d
  UNION ALL SELECT doc_id, 1, 'cell', 'word/document.xml', 'body/1/tr[0]/tc[0]/p[0]', 0, 0, 0, 'Name' FROM d
  UNION ALL SELECT doc_id, 2, 'cell', 'word/document.xml', 'body/1/tr[0]/tc[1]/p[0]', 0, 0, 1, 'Designation' FROM d
  UNION ALL SELECT doc_id, 1 + 2 * r, 'cell', 'word/document.xml', 'body/1/tr[' || r || ']/tc[0]/p[0]', 0, r, 0, t[r] FROM e
  UNION ALL SELECT doc_id, 2 + 2 * r, 'cell', 'word/document.xml', 'body/1/tr[' || r || ']/tc[1]/p[0]', 0, r, 1, 'Member' FROM e
  UNION ALL SELECT doc_id, 2 + 2 * n + r, 'body', 'word/document.xml', 'body/' || (r + 1), NULL, NULL, NULL, t[r] FROM e
  UNION ALL SELECT doc_id, 3 + 3 * n, 'header', 'word/header1.xml', 'p[0]', NULL, NULL, NULL, 'Header ' || doc_id FROM d
  UNION ALL SELECT doc_id, 4 + 3 * n, 'footer', 'word/footer1.xml', 'p[0]', NULL, NULL, NULL, 'Page' FROM d)
SELECT doc_id, CASE kind WHEN 'header' THEN 'hdr-0-' WHEN 'footer' THEN 'ftr-0-' ELSE kind || '-' END || ordinal AS unit_id, ordinal::INTEGER AS ordinal, kind, part, xml_path, table_id, row, col, text FROM u"""

_JUDGED = f"""
WITH spans AS MATERIALIZED (SELECT doc_id AS unit_id, span_start AS s, span_end AS e, category, (doc_id::BIGINT + span_start) % 7 AS turn FROM ({_DOCUMENT_SPANS})),
p AS (SELECT unit_id, s, e, category FROM spans),
g AS (SELECT unit_id, s, CASE WHEN turn IN (1, 2) THEN e + 2 ELSE e END AS e, category FROM spans WHERE turn <> 0
      UNION ALL SELECT unit_id, e + 5, e + 9, category FROM spans WHERE turn = 3)"""


def _scored(condition: str, scope: str = "true") -> str:
    """One-to-one matches: spans of a side are apart, so each gold has at most one partner that does."""
    cats = ", ".join(f"('{c}')" for c in CATEGORIES)
    return f"""{_JUDGED.replace("p AS (SELECT unit_id, s, e, category FROM spans)", f"all_p AS (SELECT unit_id, s, e, category FROM spans), p AS (SELECT * FROM all_p WHERE {scope})").replace("g AS (", "all_g AS (")},
g AS (SELECT * FROM all_g WHERE {scope}),
m AS (SELECT category, count(*) AS tp FROM (SELECT DISTINCT g.unit_id, g.category, g.s FROM g JOIN p ON g.unit_id = p.unit_id AND g.category = p.category AND {condition}) GROUP BY category),
c AS (SELECT k.category, coalesce(m.tp, 0)::BIGINT AS tp, (coalesce(np, 0) - coalesce(m.tp, 0))::BIGINT AS fp, (coalesce(ng, 0) - coalesce(m.tp, 0))::BIGINT AS fn
      FROM (VALUES {cats}) k(category) LEFT JOIN m ON m.category = k.category
      LEFT JOIN (SELECT category, count(*) AS np FROM p GROUP BY category) a ON a.category = k.category LEFT JOIN (SELECT category, count(*) AS ng FROM g GROUP BY category) b ON b.category = k.category),
f AS (SELECT * FROM c UNION ALL SELECT 'MICRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c),
r AS (SELECT *, tp + fn AS support, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM f)
SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r"""


_RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {p}" for c, p in PRIORITY.items()) + " ELSE 0 END"
_RESOLVED = f"""
WITH RECURSIVE spans AS (
  SELECT l_orderkey, s, s + 1 + l_suppkey % 15 AS e, category, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RANK} DESC, 1 + l_suppkey % 15 DESC, s, l_linenumber, l_partkey, l_suppkey) AS r
  FROM (SELECT *, l_partkey % 40 AS s, list_extract({list(RESOLVER_CATEGORIES)}, (l_partkey % {len(RESOLVER_CATEGORIES)} + 1)::INTEGER) AS category FROM lineitem)),
fold AS (
  SELECT l_orderkey, 0::BIGINT AS r, []::STRUCT(s BIGINT, e BIGINT, category VARCHAR)[] AS kept FROM (SELECT DISTINCT l_orderkey FROM lineitem)
  UNION ALL
  SELECT f.l_orderkey, x.r, CASE WHEN len(list_filter(f.kept, lambda k: k.s < x.e AND x.s < k.e)) > 0 THEN f.kept ELSE list_append(f.kept, {{'s': x.s, 'e': x.e, 'category': x.category}}) END
  FROM fold f JOIN spans x ON x.l_orderkey = f.l_orderkey AND x.r = f.r + 1)
SELECT l_orderkey, k.s::INTEGER AS span_start, k.e::INTEGER AS span_end, k.category AS category
FROM (SELECT l_orderkey, unnest(kept) AS k FROM (SELECT l_orderkey, arg_max(kept, r) AS kept FROM fold GROUP BY l_orderkey))"""

_CUSTOMER_GOLD = """
WITH u AS (SELECT c_custkey::VARCHAR AS unit_id, length(c_name) AS n, length(c_mktsegment) AS m FROM customer)
SELECT unit_id, 0 AS ordinal, 0 AS span_start, n::INTEGER AS span_end, 'NAME' AS category, NULL AS problem FROM u
UNION ALL SELECT unit_id, 1, (n + 4)::INTEGER, (n + 4 + m)::INTEGER, 'COMPANY', NULL FROM u
UNION ALL SELECT unit_id, 2, (n + 9 + m)::INTEGER, (n + 9 + 2 * m)::INTEGER, 'COMPANY', NULL FROM u
UNION ALL SELECT unit_id, 3, NULL, NULL, NULL, 'substring is missing' FROM u"""

_RUNS = """
SELECT c_custkey, unnest([0, 1, 2, 3, 4])::INTEGER AS idx, unnest([0, 5, 5, n, n])::INTEGER AS run_start, unnest([5, 5, n, n, n + m])::INTEGER AS run_end,
       unnest([substr(c_name, 1, 5), '', substr(c_name, 6), '', c_mktsegment]) AS run_text
FROM (SELECT *, length(c_name) AS n, length(c_mktsegment) AS m FROM customer)"""
_REWRITTEN = """
SELECT c_custkey, unnest([0, 1, 2, 3, 4])::INTEGER AS idx, unnest([substr(c_name, 1, a) || '<X>', '', substr(c_name, a + 7), '', c_mktsegment]) AS run_text
FROM (SELECT *, c_custkey % 5 AS a FROM customer)"""


def oracles(settings: Settings) -> dict[str, str]:
    documents = f"SELECT *, 0 AS ordinal FROM ({_DOCUMENT_SPANS})"
    mapped = _mapped(documents, settings)
    spliced = f"""
    WITH m AS MATERIALIZED ({mapped}),
    o AS (SELECT *, lag(span_end, 1, 0) OVER (PARTITION BY doc_id ORDER BY span_start) AS done FROM m),
    j AS (SELECT o.doc_id, string_agg(substr(d.text, (done + 1)::INTEGER, (span_start - done)::INTEGER) || replacement, '' ORDER BY span_start) AS head, max(span_end) AS tail FROM o JOIN documents d ON d.doc_id::VARCHAR = o.doc_id GROUP BY o.doc_id)
    SELECT d.doc_id::VARCHAR AS doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, (tail + 1)::INTEGER) END AS redacted_text FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id::VARCHAR"""
    return {
        "email_spans": _email(),
        "phone_spans": _phone(),
        "card_spans": _card(),
        "ip_spans": _ip(),
        "ssn_spans": _constructed("SSN"),
        "dob_spans": _constructed("DOB"),
        "company_spans": _constructed("COMPANY"),
        "address_spans": _constructed("ADDRESS"),
        "name_kb": _PERSONS,
        "name_tables": _MINED,
        "docx_units": _DOCX,
        "registered_spans": "SELECT c_custkey::VARCHAR AS doc_id, 'CUSTOMER' AS category, 4 AS span_start, (4 + length(c_name))::INTEGER AS span_end, c_name AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'IP', (8 + length(c_name))::INTEGER, (16 + length(c_name))::INTEGER, '10.0.0.1' FROM customer",
        "stream_windows": f"SELECT (doc_id::BIGINT * 7 // 300 * 300)::BIGINT AS window_start, category, count(*) AS redactions FROM ({_DOCUMENT_SPANS}) GROUP BY ALL",
        "eval_modes": f"SELECT *, 'strict' AS mode FROM ({_scored('g.s = p.s AND g.e = p.e')}) UNION ALL SELECT *, 'overlap' AS mode FROM ({_scored('g.s < p.e AND p.s < g.e')})",
        "eval_scope": _scored("g.s < p.e AND p.s < g.e", "unit_id::BIGINT % 3 = 0"),
        "name_spans": _constructed("NAME"),
        "profile_spans": _PROFILE_SPANS,
        "resolved_spans": _RESOLVED,
        "entity_ids": f"SELECT doc_id, category, span_start, {_digest('category', 'value', settings.salt)} AS entity_id FROM ({_DOCUMENT_SPANS})",
        "pseudonyms": f"SELECT DISTINCT h AS entity_id, category, replacement FROM ({mapped})",
        "pseudonyms_profiles": f"SELECT doc_id, ordinal, span_start, category, h AS entity_id, replacement FROM ({_mapped(_PROFILE_SPANS, settings)})",
        "redacted_text": spliced,
        "audit_events": f"SELECT doc_id, 'body-0' AS unit_id, category, h AS entity_id, replacement, span_start FROM ({mapped})",
        "audit_summary": f"SELECT category, count(*) AS redactions, count(DISTINCT category || h) AS unique_entities FROM ({mapped}) GROUP BY ROLLUP (category)",
        "leak_check": f"WITH t AS ({spliced}) SELECT count(*) AS leaks FROM ({mapped}) m JOIN t ON t.doc_id = m.doc_id WHERE contains(redacted_text, value)",
        "eval_strict": _scored("g.s = p.s AND g.e = p.e"),
        "eval_overlap": _scored("g.s < p.e AND p.s < g.e"),
        "char_accuracy": f"""{_JUDGED},
            pc AS (SELECT DISTINCT unit_id, unnest(range(s, least(e, n))) AS c FROM p JOIN (SELECT doc_id::VARCHAR AS id, length(text) AS n FROM documents) ON id = unit_id),
            gc AS (SELECT DISTINCT unit_id, unnest(range(s, least(e, n))) AS c FROM g JOIN (SELECT doc_id::VARCHAR AS id, length(text) AS n FROM documents) ON id = unit_id),
            d AS (SELECT count(*) AS n FROM ((SELECT * FROM pc EXCEPT SELECT * FROM gc) UNION ALL (SELECT * FROM gc EXCEPT SELECT * FROM pc)))
            SELECT (t - d.n)::BIGINT AS correct, t::BIGINT AS total, (t - d.n)::DOUBLE / t AS accuracy FROM d, (SELECT sum(length(text)) AS t FROM documents)""",
        "gold_build": _CUSTOMER_GOLD,
        "run_offsets": _RUNS,
        "run_rewrite": _REWRITTEN,
        "page_categories": f"SELECT category, count(*) AS spans, count(DISTINCT doc_id) AS documents FROM ({_PAGE_SPANS}) GROUP BY category",
        "page_spans": _PAGE_SPANS,
    }
