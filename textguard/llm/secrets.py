"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (assignments, access keys, long hex runs) always count. Weak candidates
(identifiers, secret-looking strings, endpoints) count only when complementary parts lie
within the same scope: an interval join of candidates and parts, on blocks of code points,
decides. An identifier needs a secret, a secret-looking string needs an identifier, an endpoint
needs both.

Rows get a number of their own while the candidates are written, so the join needs neither ids nor
texts, and rows that are alike never meet in one task. Texts are not shuffled.

Spans are code points, end exclusive. Defined results: a null text is empty and has no
spans; very long texts are scanned whole; a null id is passed on; repeated rows each get their own
result; of spans with one start the order is that of the kinds, then of the ends; an empty table gives
no rows; other columns are ignored (or passed on by ``mask_secrets``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import Scratch

# Patterns of the strong kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
# Weak kinds: only together with complementary parts.
IDENT = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
# maximal runs, of any length; which of them look secret is tested on the run. A run with _ may be a name in a program: it
# counts after a known prefix, or where small and capital letters and digits mix (base64url)
SECRET = r"[A-Za-z0-9+/_=-]{20,}"
SECRET_RUN = r"^(?:(?:gh[oprsu]|github_pat|glpat|[prs]k_(?:live|test)|npm|hf)_[A-Za-z0-9_-]+|[A-Za-z0-9+/-]{20,}={0,2})$"
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{3,}"
SECRET_MIXED = r"^[A-Za-z0-9_-]{20,}={0,2}$"
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
#: Code points within which parts belong together.
SCOPE = 256
#: Part that each kind plays in a credential.
PARTS = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "secret": "secret", "endpoint": "endpoint"}
_SPAN = "struct<s:int,e:int,k:int>"


def found_spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that ``keep`` accepts: what lies between matches gives the offsets."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        span = F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("k"))
        return F.struct(e.alias("at"), F.when(keep(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("hit"))
    pairs = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def strong_spans(text: Column) -> list[Column]:
    """Arrays of spans of the three strong kinds."""
    return [
        found_spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_MIN),
        found_spans(text, ACCESS, 1, lambda m: F.length(m) >= ACCESS_MIN),
        _long_hex(text),
    ]


def _long_hex(text: Column) -> Column:
    # hex runs are maximal, so the short ones need not be looked at one by one
    return found_spans(text, f"{HEX[:-1]}{{{HEX_MIN},}}", 2, lambda m: F.lit(True))


def weak_spans(text: Column) -> list[Column]:
    """Arrays of spans of the three weak kinds, none of them bounded in length."""
    every = lambda m: F.lit(True)
    secret = lambda m: m.rlike("[0-9]") & ((m.rlike(SECRET_RUN) & m.rlike("[A-Za-z]")) | (m.rlike(SECRET_MIXED) & m.rlike("[a-z]") & m.rlike("[A-Z]")))
    return [found_spans(text, p, k, keep) for k, p, keep in ((3, IDENT, every), (4, SECRET, secret), (5, ENDPOINT, every))]


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def linked_spans(candidates: DataFrame) -> DataFrame:
    """Weak spans with their complementary parts in scope; rows (key, weak: array of spans).

    ``candidates`` has one row per text: key, strong and weak (arrays of spans). The interval
    join meets a weak span and the parts of its block of ``SCOPE`` code points or the next
    ones; spans of a kind are disjoint, so a block holds a bounded number of them.
    """
    weak = candidates.select("key", F.explode("weak").alias("w"))
    parts = candidates.select("key", F.explode(F.concat("strong", "weak")).alias("p"))
    role = F.element_at(F.array(*[F.lit(PARTS[k]) for k in KINDS]), F.col("p.k") + 1)
    blocks = lambda c, reach: F.explode(F.sequence(F.floor((c["s"] - reach) / SCOPE), F.floor((c["e"] + reach) / SCOPE)))
    left = weak.withColumn("block", blocks(F.col("w"), SCOPE))
    right = parts.withColumn("role", role).withColumn("block", blocks(F.col("p"), 0))
    near = (F.col("p.s") < F.col("w.e") + SCOPE) & (F.col("w.s") < F.col("p.e") + SCOPE)
    met = left.join(right, ["key", "block"]).where(near & (F.col("w") != F.col("p")))
    has = met.groupBy("key", "w").agg(*[F.max(F.col("role") == r).alias(r) for r in ("ident", "secret", "endpoint")])
    k = F.col("w.k")
    linked = ((k == 3) & F.col("secret")) | ((k == 4) & F.col("ident")) | ((k == 5) & F.col("ident") & F.col("secret"))
    return has.where(linked).groupBy("key").agg(F.collect_list("w").alias("linked"))


def _candidates(docs: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``columns`` of every row with its number, its strong and its weak spans; one pass over the texts.

    Written to shared scratch in two folders, of rows with spans (__met) and of rows without.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strong, weak = reduce(F.concat, strong_spans(text)), reduce(F.concat, weak_spans(text))
    rows = docs.select(*columns, F.monotonically_increasing_id().alias("__key"), strong.alias("__strong"), weak.alias("__weak"))
    # a weak span that overlaps a strong one adds nothing
    rows = rows.withColumn("__weak", F.filter("__weak", lambda w: ~F.exists("__strong", lambda s: _overlap(w, s))))
    return Scratch(docs.sparkSession, label).put(rows.withColumn("__met", F.size("__strong") + F.size("__weak") > 0), label, ("__met",))


def _with_spans(rows: DataFrame) -> DataFrame:
    """Rows that met something, with __spans: the strong and the linked ones by their starts."""
    met = rows.where("__met")
    linked = linked_spans(met.where(F.size("__weak") > 0).select(F.col("__key").alias("key"), F.col("__strong").alias("strong"), F.col("__weak").alias("weak")))
    joined = met.join(linked.withColumnRenamed("key", "__key"), "__key", "left")
    return joined.withColumn("__spans", F.array_sort(F.concat("__strong", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>"))), _by_start)).drop("linked")


def _by_start(a: Column, b: Column) -> Column:
    order = lambda x: F.struct(x["s"], x["k"], x["e"])
    return F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)


def _listed(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report_secrets(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    rows = _candidates(docs, ["doc_id"], "secrets")
    none = F.array().cast(f"array<{_SPAN}>").alias("__spans")
    all_ = _with_spans(rows).select("doc_id", "__strong", "__spans").union(rows.where(~F.col("__met")).select("doc_id", "__strong", none))
    count = lambda k: F.size(F.filter("__strong", lambda x: x["k"] == k)).cast("long")
    base = F.sha2(_listed(F.array_sort("__strong", _by_start)).cast("binary"), 256)
    return all_.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), base.alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]`` and ``n_chars`` brought up to date.

    Overlapping spans become one mask named by the first. Texts without spans are unchanged and are
    never shuffled; those with spans are joined with what was linked in them by their number.
    """
    rows = _candidates(docs, docs.columns, "masked")
    name = lambda x: F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1))

    def step(acc, x):
        grown = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        gap = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        masked = F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit("["), name(x), F.lit("]")).alias("out"))
        return F.when(x["s"] < acc["at"], grown).otherwise(masked)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"]))
    fixed = _with_spans(rows).withColumn("text", F.aggregate("__spans", start, step, rest))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.when(F.size("__spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return fixed.select(*docs.columns).union(rows.where(~F.col("__met")).select(*docs.columns))


# The same grammar for DuckDB, whose patterns know neither look-around nor ASCII-only case folding:
# letters in either case are classes, and a secret-looking string is a whole run that passes tests.
def _either(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_TAIL = r"""["']?\x20*[:=]\x20*["']?"""
_SQL_PATTERNS = (
    f"({_either('password|passwd|secret|token|api_?key')}){_TAIL}([A-Za-z0-9+/_.=-]+)",
    ACCESS,
    f"{HEX[:-1]}{{{HEX_MIN},}}",
    f"({_either('access_?key_?id|client_?id|account_?id|user_?name|login|user')}){_TAIL}[A-Za-z0-9_.@-]{{3,}}",
    "[A-Za-z0-9+/_=-]+",
    f"({_either('https?')}|{_either('jdbc')}:[A-Za-z]+|{_either('postgres|mysql|mongodb|redis|amqp')})" + r"""://[^\x20\x09-\x0D"'<>]{3,}""",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _of_kind(values, column: str = "k") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_KEPT = (f"length(regexp_extract(hit, {_quoted(_SQL_PATTERNS[0])}, 2)) >= {ASSIGN_MIN}", f"length(hit) >= {ACCESS_MIN}", "true", "true", f"length(hit) >= 20 AND regexp_matches(hit, '[0-9]') AND ((regexp_matches(hit, {_quoted(SECRET_RUN)}) AND regexp_matches(hit, '[A-Za-z]')) OR (regexp_matches(hit, {_quoted(SECRET_MIXED)}) AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')))", "true")
_EACH = " UNION ALL ".join(f"SELECT n, {k} AS k, regexp_extract_all(t, {_quoted(p)}) AS h, string_split_regex(t, {_quoted(p)}) AS g FROM texts" for k, p in enumerate(_SQL_PATTERNS))
_WORD = f"{_of_kind(map(_quoted, KINDS))} || ':' || s || ':' || e"
ORACLE = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS n, t FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)),
found AS ({_EACH}),
hits AS (SELECT n, k, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS hit, unnest(list_slice(g, 1, len(h))) AS gap FROM found WHERE len(h) > 0),
placed AS (SELECT n, k, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY n, k ORDER BY i))::BIGINT AS e FROM hits),
span AS MATERIALIZED (SELECT n, k, e - length(hit) AS s, e FROM placed WHERE {_of_kind(_KEPT)}),
strong AS (SELECT * FROM span WHERE k < 3),
weak AS (SELECT * FROM span w WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM strong x WHERE x.n = w.n AND x.s < w.e AND w.s < x.e)),
part AS (SELECT *, {_of_kind(_quoted(PARTS[kind]) for kind in KINDS)} AS role FROM (SELECT * FROM strong UNION ALL SELECT * FROM weak)),
near AS (SELECT w.n, w.k, w.s, w.e, bool_or(p.role = 'ident') AS ident, bool_or(p.role = 'secret') AS secret
         FROM weak w JOIN part p ON p.n = w.n AND p.s < w.e + {SCOPE} AND w.s < p.e + {SCOPE} AND (p.s, p.e, p.k) <> (w.s, w.e, w.k) GROUP BY w.n, w.k, w.s, w.e),
kept AS (SELECT n, k, s, e FROM strong UNION ALL SELECT n, k, s, e FROM near WHERE {_of_kind(("false", "false", "false", "secret", "ident", "ident AND secret"))}),
listed AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg({_WORD}, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg({_WORD}, ',' ORDER BY s, k, e) AS spans FROM kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents JOIN texts ON t = coalesce(text, '') LEFT JOIN listed USING (n)
"""
