"""The languages of the detectors, which must match exactly for right results.

``(?U)`` gives character classes their Unicode meaning.
"""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<![\d,.])(?:\+\s?)?(?:91[\s-]?|0)?(?:\(?\d{2,5}\)?[\s-]?)?\d{3,5}[\s-]?\d{3,6}(?!\d)"
PHONE_UNITS = r"(?U)^\s*(million|billion|crore|lakh|%|per cent)"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
CREDIT_CARD = r"(?U)\b(?:\d[ -]?){13,16}\b"
IP = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
DATE = (
    r"(?U)\b(?:\d{1,2}\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
)
DOB_TRIGGER = r"(?i)(date of birth|born on|born|d\.?o\.?b\.?|aged)"

HONORIFIC_NAME = r"(?U)(?:Mr|Ms|Mrs|Dr|Shri|Smt)\.?\s+([A-Z][a-zA-Z.]+(?:\s+[A-Z][a-zA-Z.]+){1,3})"
ROLE_NAME = r"(?U)([A-Z][a-zA-Z.]+(?:\s+[A-Z][a-zA-Z.]+){1,3})\s+is\s+our\b"
CONTACT_NAME = r"(?U)Contact\s+Person[s]?\s*:?\s*([A-Z][a-zA-Z.]+(?:\s+[A-Z][a-zA-Z.]+){1,3})"
BEING_NAME = r"(?U)being\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
TABLE_NAME_NOISE = r"[*^&#()0-9]"
NAME_STOP = tuple(
    """the our and of to from also formerly board directors director promoter promoters group company committee shareholder
    shareholders equity share offer trust family limited private registered office india corporate identity chairman managing whole
    wholetime independent executive additional statutory auditors auditor compliance officer secretary chief financial manager head
    president website tel telephone email e-mail sebi registration address escrow refund syndicate sponsor collection account
    designated intermediaries members member lead managers book running registrar bank banks fund capital securities regulations act
    total subtotal sub-total anchor investor pay category particulars no name designation din""".split()
)

COMPANY_SUFFIX = r"(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Limited|Ltd\.?|LLP|Corporation|Corp\.?|Co\.|Associates)"
COMPANY_WORD = r"(?:and|of|the|&|\([A-Za-z]+\)|[A-Z0-9][A-Za-z0-9&.()\-]*)"
COMPANY = rf"(?U)[A-Z][A-Za-z0-9&.()\-]*(?:[ \t\n]+{COMPANY_WORD}){{0,6}}?[ \t\n]+{COMPANY_SUFFIX}(?!\w)"
COMPANY_LEAD = tuple(
    """company bank banks issue fresh offer public registrar promoter corporate the and of designated sponsor escrow refund syndicate
    members lead managers book running account collection our formerly also to from shareholders shareholder investor anchor capital
    short long term positive stable net working proposed family trust""".split()
)
COMPANY_CODE = r"(?:[A-Z]{1,4}\d{3,}[A-Z0-9]*|[UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})"
TRUST = r"(?U)[A-Z][a-z]+\s+Family\s+Trust"

ADDRESS_KEYWORD = (
    r"(?:Road|Marg|Society|Apartment|Bunglow|Bungalow|Nagar|Colony|Gymkhana|Residency|Park|Gat\s*No\.?|S\.?\s*no\.?|Plot\s*No\.?|Plot|"
    r"Village|Taluka|Floor|Tower|MIDC|Industrial|Complex|Chambers|Estate)"
)
ADDRESS = rf"(?U)[A-Z0-9][^\n]{{5,160}}?{ADDRESS_KEYWORD}[^\n]{{0,160}}?\b\d{{3}}\s?\d{{3}}\b"
#: What every address ends in.
ADDRESS_END = rf"(?U){ADDRESS_KEYWORD}[^\n]{{0,160}}?\b\d{{3}}\s?\d{{3}}\b"
ADDRESS_LEAD = r"(?Uid)^.*?(?:located at|situated at|plant at|facility at|Registered Office:|Corporate Office:|Office:)\s*"
ADDRESS_COMPANY = (
    r"(?U)^(?:[A-Z][A-Za-z0-9&.()\-]*\s+)*?(?:[A-Z][A-Za-z0-9&.()\-]*|and|of|&)\s+"
    r"(?:Limited|Ltd\.?|LLP|Corporation|Corp\.?|Co\.|Associates)\s+(?=[A-Z0-9])"
)
CITY_CODE = r"(?U)\b[A-Z][a-z]+(?:\s*[–-]\s*|\s+)\d{3}\s?\d{3}\b"

#: Endings a synthetic company keeps.
KEPT_SUFFIX = r"(Limited|Ltd\.?|LLP|Securities|Capital|Advisors|Bank|Ventures|Partners|Technologies|Industries|Financial Services)$"
