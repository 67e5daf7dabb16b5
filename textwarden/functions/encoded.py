"""What must stand in a text for one of its Base64 blobs to hold a secret.

Every detector needs one of a few words in the decoded text.  In Base64 a word has three forms, one for each
place its first byte may have among three, and each form is a short chain of characters: those of
its own bits alone, and a few choices where case or a neighbouring byte decides.  A text without any
of these chains has no such blob, so it is neither cut into blobs nor decoded.
"""

from __future__ import annotations

import string

# The Base64 alphabet, in the order of its values.
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_ANY = frozenset(range(256))


def _word(text: str) -> list[frozenset[int]]:
    return [frozenset((c.lower() + c.upper()).encode()) for c in text]


def _bytes(value: bytes) -> list[frozenset[int]]:
    return [frozenset((b,)) for b in value]


#: Each detector needs one of these, a set of bytes for each place. The Kelvin sign folds into k; words with
#: an s that may be U+017F are cut short of it, or take its last byte (before ``://``).
NEEDED: tuple[list[frozenset[int]], ...] = (
    _word("word"),
    _word("ecret"),
    _word("token"),
    _word("apikey"),
    [*_word("api"), frozenset(b"-_"), *_word("key")],
    _word("author"),
    [frozenset(b"slbepSLBEP\xbf"), *_bytes(b"://")],
    _word("akia"),
    _bytes(b"PRIVATE"),
    _bytes(b"\xe2\x84\xaa"),
)


def chain(word: list[frozenset[int]], shift: int) -> list[set[str]]:
    """The characters that may stand at each place of an encoded word that begins ``shift`` bytes into a group of three."""
    places = [_ANY] * shift + word
    places += [_ANY] * (-len(places) % 3)
    found: list[set[int]] = []
    for i in range(0, len(places), 3):
        a, b, c = places[i : i + 3]
        found += [
            {x >> 2 for x in a},
            {(x & 3) << 4 | y >> 4 for x in a for y in b},
            {(y & 15) << 2 | z >> 6 for y in b for z in c},
            {z & 63 for z in c},
        ]
    tells = [i for i, values in enumerate(found) if len(values) < 64]
    return [{ALPHABET[v] for v in values} for values in found[tells[0] : tells[-1] + 1]]


def _rare(choices: set[str]) -> bool:
    return not any(c.islower() for c in choices)


def _tail(choices: list[set[str]]) -> str:
    return "".join("[" + "".join(sorted(c)) + "]" for c in choices)


def _guard() -> str:
    """One pattern for all chains.

    Each has a place, not its first, where no lower-case letter can stand. In prose such a character
    rarely follows a letter, so the search stops only there and looks at the chain from that place, both ways.
    """
    ways = []
    for word in NEEDED:
        for shift in range(3):
            links = chain(word, shift)
            stop = next(i for i, choices in enumerate(links) if i and _rare(choices))
            ways.append(f"(?<={_tail(links[: stop + 1])}){_tail(links[stop + 1 :])}")
    return f"[A-Z0-9+/](?<=[A-Za-z0-9+/]{{2}})(?:{'|'.join(ways)})"


GUARD = _guard()
