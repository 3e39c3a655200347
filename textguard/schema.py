"""Shapes of the data: categories, spans, units, and the policy of a run."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

# The categories in scoring order, and their priority where spans overlap.
CATEGORIES = ("EMAIL", "PHONE", "NAME", "COMPANY", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP")
PRIORITY = {"ADDRESS": 5, "NAME": 4, "COMPANY": 4, "EMAIL": 3, "PHONE": 3, "SSN": 3, "CREDIT_CARD": 3, "DOB": 3, "IP": 3}
#: Exempt organisations, matched as substrings of the lower-cased name.
ALLOWLIST = (
    "SEBI",
    "Securities and Exchange Board of India",
    "BSE",
    "BSE Limited",
    "NSE",
    "National Stock Exchange of India Limited",
    "Reserve Bank of India",
    "RBI",
    "Registrar of Companies",
    "RoC",
    "Stock Exchanges",
    "Government of India",
    "Ministry of Corporate Affairs",
)

#: A detected span; offsets are code points, ``end`` is exclusive.
SPAN = "struct<start:int,end:int,text:string,category:string,detector:string,confidence:double>"
#: A unit of text with its place in the document.
UNITS = "doc_id string, unit_id string, ordinal int, kind string, part string, xml_path string, table_id int, row int, col int, text string, runs array<struct<idx:int,start:int,end:int,text:string>>"
#: Salt for tests and trials only; whoever knows it can guess short values from their digests.
PUBLIC_SALT = "textguard-public-salt"


@dataclass(frozen=True)
class Settings:
    """Policy of a run."""

    categories: tuple[str, ...] = CATEGORIES
    company_allowlist: tuple[str, ...] = ALLOWLIST
    salt: str = PUBLIC_SALT
    match_mode: str = "overlap"
    use_ner: bool = False
    ner_model: str = "en_core_web_sm"
    phone_regions: tuple[str, ...] = ("IN", "INTL")
    extended_identifiers: dict = field(default_factory=dict)
    anchor_date: str = "2024-01-01"

    def only(self, categories) -> Settings:
        """The same policy for those of ``categories`` that exist."""
        from dataclasses import replace

        wanted = set(categories)
        return replace(self, categories=tuple(c for c in CATEGORIES if c in wanted))


def load_settings(path: str | None = None) -> Settings:
    """Policy from a YAML file; the environment's PII_SALT wins over the file's salt."""
    data: dict = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    on = data.get("categories")
    salt = os.environ.get("PII_SALT") or (data.get("pseudonymization") or {}).get("salt")
    if not salt:
        warnings.warn("no salt is set: digests of short values can be guessed", stacklevel=2)
    ner = data.get("ner") or {}
    return Settings(
        categories=CATEGORIES if on is None else tuple(c for c in on if on[c]),
        company_allowlist=tuple((data.get("company") or {}).get("allowlist", ALLOWLIST)),
        salt=salt or PUBLIC_SALT,
        match_mode=(data.get("evaluation") or {}).get("match_mode", "overlap"),
        use_ner=bool(ner.get("use_spacy", False)),
        ner_model=ner.get("model", "en_core_web_sm"),
        phone_regions=tuple((data.get("phone") or {}).get("regions", ("IN", "INTL"))),
        extended_identifiers=dict(data.get("extended_identifiers") or {}),
    )
