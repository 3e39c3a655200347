"""Names, companies and addresses: rules, and a knowledge base of persons per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.spans import cut, let, matches, no_matches, no_spans, overlap, span_extract, tagged

# ---------------------------------------------------------------- persons


def clean_person(candidate: Column) -> Column:
    """A valid person name of 2 to 4 tokens without label words at its ends, else null."""
    stops = F.array(*map(F.lit, P.NAME_STOP))
    named = lambda tokens: F.transform(tokens, lambda t: ~F.array_contains(stops, F.lower(F.regexp_replace(t, "^[.,]+|[.,]+$", ""))))

    def inner(tokens: Column, flags: Column) -> Column:
        """Tokens from the first to the last that is not a stop word."""
        first, last = F.array_position(flags, True), F.array_position(F.reverse(flags), True)
        return F.when(first > 0, F.slice(tokens, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(tokens) - first - last + 2, F.lit(0)).cast("int")))

    core = lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")
    valid = lambda t: core(t).rlike(r"^\p{Lu}") & ~core(t).rlike(r"(?U)\d") & ~F.array_contains(stops, F.lower(core(t))) & ((F.length(core(t)) > 1) | t.endswith("."))
    checked = lambda kept: F.when(F.size(kept).between(2, 4) & F.forall(kept, valid), F.array_join(kept, " "))
    tokens = F.filter(F.split(F.regexp_replace(candidate, r"(?U)\s+", " "), " "), lambda t: t != "")
    return let(let(tokens, lambda t: let(named(t), lambda flags: inner(t, flags))), checked)


def person_candidates(text: Column) -> Column:
    """What the four anchors introduce in a text, uncleaned."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (P.HONORIFIC_NAME, P.ROLE_NAME, P.CONTACT_NAME, P.BEING_NAME)])


def mine_text(units: DataFrame) -> DataFrame:
    """(doc_id, person) from each document's units joined in order: anchors may span units."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    whole = units.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    found = whole.select("doc_id", F.explode(person_candidates(F.col("text"))).alias("candidate"))
    return found.select("doc_id", clean_person(F.col("candidate")).alias("person")).where(F.col("person").isNotNull()).distinct()


def mine_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, person) from tables with a name column and a role word in the header.

    ``cells``: doc_id, table_id, row, col, text of top-level tables; row 0 is the header.
    """
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]))
    grid = cells.where(F.col("table_id").isNotNull()).groupBy("doc_id", "table_id", "row", "col").agg(text.alias("text"))
    head = grid.where(F.col("row") == 0).withColumn("h", F.lower(F.trim("text")))
    named = head.groupBy("doc_id", "table_id").agg(F.min(F.when(F.col("h").startswith("name"), F.col("col"))).alias("col"), F.max(F.col("h").rlike("din|designation|promoter|shareholder")).alias("roles"))
    column = named.where(F.col("col").isNotNull() & F.col("roles")).select("doc_id", "table_id", "col")
    people = grid.where(F.col("row") > 0).join(column, ["doc_id", "table_id", "col"])
    return people.select("doc_id", clean_person(F.regexp_replace("text", P.TABLE_NAME_NOISE, " ")).alias("person")).where(F.col("person").isNotNull()).distinct()


def with_aliases(persons: DataFrame) -> DataFrame:
    """Persons, and first with last token of those of three or four."""
    tokens = F.split("person", " ")
    alias = F.concat_ws(" ", F.element_at(tokens, 1), F.element_at(tokens, -1))
    short = persons.where(F.size(tokens) >= 3).select("doc_id", clean_person(alias).alias("person"))
    return persons.select("doc_id", "person").union(short.where(F.col("person").isNotNull())).distinct()


def knowledge_base(units: DataFrame) -> DataFrame:
    """(doc_id, person) of every document, from text and (where units have cells) from tables."""
    found = mine_text(units)
    if "table_id" in units.columns:
        found = found.union(mine_tables(units))
    return with_aliases(found)


def name_patterns(persons: DataFrame) -> DataFrame:
    """(doc_id, names, name_pattern): one alternation per document, longest names first."""
    quoted = F.regexp_replace("person", r"(?U)([^\w\s])", r"\\$1")
    longest = F.array_sort(F.collect_set(F.struct((-F.length("person")).alias("n"), quoted.alias("q"))))
    joined = F.array_join(F.transform(longest, lambda x: x["q"]), "|")
    return persons.groupBy("doc_id").agg(F.collect_set("person").alias("names"), F.concat(F.lit(r"(?U)(?<!\w)(?:"), joined, F.lit(r")(?!\w)")).alias("name_pattern"))


def name(text: Column, names: Column, pattern: Column) -> Column:
    """Occurrences of the document's persons; both are null where there are none. A pattern is compiled only for texts that hold a name."""
    there = F.coalesce(F.exists(names, lambda n: F.contains(text, n)), F.lit(False))
    return span_extract(text, pattern, "NAME", "kb.name", 0.95, when=there)


# ---------------------------------------------------------------- companies


def _prefix_length(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(value, pattern, 0))


def company(text: Column, allowlist: tuple[str, ...]) -> Column:
    """Names with a legal suffix, without leading labels, and family trusts."""
    words = "|".join(P.COMPANY_LEAD)
    lead = rf"^(?:(?:\.*(?i:{words})\.*|{P.COMPANY_CODE})[ \t\n]+)*"
    allowed = F.array(*[F.lit(a.lower()) for a in allowlist]) if allowlist else F.array().cast("array<string>")
    collapsed = lambda v: F.lower(F.regexp_replace(v, r"(?U)\s+", " "))
    bare = lambda v: F.trim(F.regexp_replace(v, rf"(?U){P.COMPANY_SUFFIX}\s*$", "")) == ""
    only = rf"(?Ui)^\s*{P.COMPANY_SUFFIX}\s*$"
    found = F.transform(matches(text, P.COMPANY), lambda m: let(_prefix_length(m["text"], lead), lambda n: cut(m["text"], m["start"], n, F.lit(0))))
    real = F.filter(found, lambda m: ~bare(m["text"]) & ~m["text"].rlike(only) & ~F.exists(allowed, lambda a: F.contains(collapsed(m["text"]), a)))
    # a trust never ends like a suffixed name, so the two cannot be the same span
    suffixed = F.when(text.rlike("Limited|Ltd|LLP|Corp|Co\\.|Associates"), tagged(real, "COMPANY", "rule.company", 0.9)).otherwise(no_spans())
    trusted = F.when(F.contains(text, F.lit("Trust")), tagged(matches(text, P.TRUST), "COMPANY", "rule.company", 0.9)).otherwise(no_spans())
    return F.concat(suffixed, trusted)


# ---------------------------------------------------------------- addresses


def address(text: Column) -> Column:
    """Keyword-anchored runs that end in a postal code, then lone city names with a code."""

    def shorter(m: Column, pattern: str) -> Column:
        n = _prefix_length(m["text"], pattern)
        return let(F.when(n < F.length(m["text"]), n).otherwise(0), lambda left: cut(m["text"], m["start"], left, F.lit(0)))

    # the pattern goes on from each capital and figure of a text without an address, its end only from each keyword
    there = F.when(text.rlike(P.ADDRESS_END), matches(text, P.ADDRESS)).otherwise(no_matches())
    full = F.transform(F.transform(there, lambda m: shorter(m, P.ADDRESS_LEAD)), lambda m: shorter(m, P.ADDRESS_COMPANY))
    city = lambda found: F.filter(matches(text, P.CITY_CODE), lambda c: ~F.exists(found, lambda m: overlap(m, c)))
    spans = lambda found: F.concat(tagged(found, "ADDRESS", "rule.address", 0.85), tagged(city(found), "ADDRESS", "rule.address", 0.7))
    return F.when(text.rlike(r"(?U)\d{3}\s?\d{3}"), let(full, spans)).otherwise(no_spans())
