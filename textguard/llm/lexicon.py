"""Function words of four languages: anchors for fingerprints and a text-only language group."""

from __future__ import annotations

import re

# Common function words; public knowledge, in no particular weighting.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as by be this at from or have an not but they his her which you had were there been their has more if will would who what so can when".split(),
    "de": "der die und das ist nicht ein eine zu den von mit sich auf für im dem des auch es an als wie er sie wird bei oder sind war noch nach aus am wenn nur haben werden ich wir".split(),
    "fr": "le la les et des est une un du que dans pour qui sur pas plus par au ce il ne se avec sont mais ou nous vous elle cette son leur aux ont ses être fait".split(),
    "es": "el los las y es una un del que para por con no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split(),
}
#: Every word of the lists; its position in a text opens a chain.
ANCHORS = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
#: Language group by word; words of several lists vote for each of them.
VOTES = {w: tuple(i for i, words in enumerate(FUNCTION_WORDS.values()) if w in words) for w in ANCHORS}
GROUPS = (*FUNCTION_WORDS, "other")
LETTERS = re.compile(r"[^\W\d_]+")
#: By Latin-1 byte: what stays of it in a lower-cased text when words are taken.
_BYTES = bytes(k if LETTERS.match(chr(k)) else 32 for k in range(256))


def letter_words(text: str) -> list[str]:
    """``LETTERS.findall`` of the lower-cased text; without a scan by pattern if Latin-1 can hold that."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_BYTES).decode("latin-1").split()
    except UnicodeEncodeError:
        return LETTERS.findall(text)


def language_group(words: list[str]) -> int:
    """Index into GROUPS by votes of function words; the last one if none occurs."""
    counts = [0] * len(FUNCTION_WORDS)
    for w in words:
        for i in VOTES.get(w, ()):
            counts[i] += 1
    best = max(counts)
    return counts.index(best) if best else len(FUNCTION_WORDS)
