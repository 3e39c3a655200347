"""URL filter: rules by host suffix and path prefix, then logistic regression on hashed n-grams.

Features are character n-grams of host and path, hashed into a fixed table, each side a set; the model
is trained in numpy on a small labelled URL table. That table is made by rule from general topics and invented
names, and knows nothing of the pages to be judged. Host, path, rule and verdict are DataFrame functions; only the
score of urls without a rule comes from Python, a batch at a time.

Defined results: a null url or one without ``://`` has empty host and path and is judged
by the model's bias alone; very long urls are judged whole; of rules that fit, the longest wins; repeated
rows are judged each; an empty table gives no rows; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import small_batches

# The rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
GRAMS, BUCKETS, EPOCHS, RATE, DECAY = (3, 4, 5), 1 << 16, 400, 0.3, 2e-3
#: Logit from which a url without a rule is blocked.
THRESHOLD = 0.0
#: Texts whose sum of weights one worker keeps.
CACHE_TEXTS = 50_000

# What the labelled table is made of: topics that are blocked and topics that are not, and invented names.
BLOCKED_TOPICS = """casino poker roulette slots jackpot lottery bet bets betting odds wager pills pharma viagra meds steroids
adult porn xxx sex escort cams nude ads adserver banner popup click track tracker telemetry spam bulkmail linkfarm seo win winner
prize sweepstake payday loan crypto quickcash replica crack keygen warez torrent phishing malware""".split()
OPEN_TOPICS = """news library garden school museum recipes history journal university weather theatre harbour books science music
travel forum wiki maps radio park sport kitchen art film poetry council docs hospital knitting hiking writing bridge river""".split()
_HEADS, _MIDDLES, _ENDS = "ba ke lo mi ru sa ti vo".split(), "bar den fin gol mer nus".split(), "a eth ion ly or us".split()
NAMES = ["".join(x) for x in product(_HEADS, _MIDDLES, _ENDS)]
_SUBDOMAINS, _SUFFIXES = ("", "www.", "m.", "blog.", "shop."), ("test", "example", "invalid", "co.test", "site.example")
_PATHS = ("/", "/en/{k}", "/fr/{k}.html", "/{k}/", "/es/{k}?page=2", "", "/de/{k}#top", "/a/{k}/b")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 if it is to be blocked): each topic with names before and after it, and names alone."""
    out = []
    for label, topics in ((1, BLOCKED_TOPICS), (0, OPEN_TOPICS)):
        for t, topic in enumerate(topics):
            for j in range(4):
                k = 41 * t + 97 * j + 13 * label
                name = NAMES[k % len(NAMES)]
                host = (f"{topic}-{name}", f"{name}-{topic}", f"{topic}{name}", f"{name}.{topic}")[j]
                out.append((f"http://{_SUBDOMAINS[k % 5]}{host}.{_SUFFIXES[k % 3 + j % 3]}{_PATHS[k % 8].format(k=k * 7919 % 10007)}", label))
    for k, name in enumerate(NAMES):
        out.append((f"https://{_SUBDOMAINS[k % 5]}{name}.{_SUFFIXES[k % 5]}{_PATHS[k % 8].format(k=k * 7919 % 10007)}", 0))
    return out


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Host with A-Z lowered; empty without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(side: str, text: str) -> set[int]:
    """Buckets of the n-grams of one side (h or p), its ends marked; a side of no characters has none."""
    import zlib

    if not text:
        return set()
    raw = f"^{text}$".encode("utf-8", "surrogatepass")
    return {zlib.crc32(side.encode() + raw[k : k + n]) % BUCKETS for n in GRAMS for k in range(len(raw) - n + 1)}


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    return rest.split("/")[0].lower(), "/" + rest.split("/", 1)[1] if "/" in rest else ""


@lru_cache(1)
def train() -> tuple[dict[int, float], float]:
    """Weights of the hashed features and the bias, by full-batch gradient steps."""
    import numpy as np

    table = labelled_urls()
    rows = [[*features("h", h), *features("p", p.lower())] for h, p in (_split(u) for u, _ in table)]
    truth = np.array([y for _, y in table], np.float64)
    used = sorted({k for r in rows for k in r})
    at = {k: i for i, k in enumerate(used)}
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        np.add.at(x[i], [at[k] for k in r], 1.0)
    w, b, step = np.zeros(len(used)), 0.0, RATE / np.sqrt((x * x).sum(axis=1).mean())
    for _ in range(EPOCHS):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - truth
        w -= step * (x.T @ g / len(rows) * 8 + DECAY * w)
        b -= step * g.mean() * 8
    return {k: round(float(w[at[k]]), 9) for k in used}, round(float(b), 9)


def scorer(weights: dict[int, float], bias: float):
    """Logits of whole batches of (host, path); what a text adds is computed once while it is kept."""

    @F.pandas_udf("double")
    def logit(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        kept: dict[tuple[str, str], float] = {}

        def total(side: str, text: str) -> float:
            if (side, text) not in kept:
                if len(kept) >= CACHE_TEXTS:
                    kept.clear()
                kept[side, text] = sum(weights.get(k, 0.0) for k in sorted(features(side, text)))
            return kept[side, text]

        return pd.Series([bias + total("h", h) + total("p", p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    return logit


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Host, path, rule, verdict and the model's logit (null where a rule decides) of every page; only id and url are read."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    known = rows.withColumns({"rule": rule, "verdict": verdict})
    scored = known.withColumn("score", F.when(F.col("verdict").isNull(), scorer(*train())("host", _lower(F.col("path")))))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def oracle() -> str:
    """The contract for DuckDB: features as crc32 of bytes, weights as a table."""
    weights, bias = train()
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    asked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in asked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in asked)
    return f"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
weights(k, w) AS MATERIALIZED (VALUES {", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in weights.items())}),
urls AS MATERIALIZED (SELECT url, {low("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT DISTINCT url FROM pages)),
sides AS MATERIALIZED (SELECT DISTINCT side, body FROM (SELECT 'h' AS side, host AS body FROM urls UNION ALL SELECT 'p', {low('path')} FROM urls) WHERE body <> ''),
grams AS (SELECT side, body, n, hx, unnest(range(0, length(hx) // 2 - n + 1)) AS k FROM (SELECT side, body, hex(encode('^' || body || '$')) AS hx FROM sides), (VALUES {", ".join(f"({n})" for n in GRAMS)}) g(n)),
hashed AS (SELECT DISTINCT side, body, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(side)) || substr(hx, 2 * k + 1, 2 * n), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % {BUCKETS} AS k FROM grams, crc),
sums AS (SELECT side, body, sum(w) AS z FROM hashed JOIN weights USING (k) GROUP BY side, body)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END, CASE WHEN {bias!r} + coalesce(h.z, 0) + coalesce(p.z, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN urls ON pages.url IS NOT DISTINCT FROM urls.url
LEFT JOIN sums h ON h.side = 'h' AND h.body = host LEFT JOIN sums p ON p.side = 'p' AND p.body = {low('path')}
"""
