"""Text normalisation as Spark columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(text: str) -> str:
    """Compatibility decomposition without combining marks, in upper case."""
    base = [ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)]
    return "".join(base).upper()


# Characters beyond these planes have no decomposition.
_FOLDED_RANGES = ((0x61, 0x7B), (0x80, 0xD800), (0xE000, 0x20000), (0x2F800, 0x2FA20))
# Private characters that no folded text holds, as separators of a list of images.
_NEXT, _GIVES = "\ue000", "\ue001"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str]:
    """The fold of every character that changes: (characters, their one-character images followed by nothing
    for marks, characters with longer images, these images as a list).

    Folding works character by character, so the tables follow from the
    Unicode rule itself.
    """
    single, gone, longer = {}, [], {}
    for low, high in _FOLDED_RANGES:
        for code in range(low, high):
            ch = chr(code)
            image = _fold(ch)
            if image == ch:
                continue
            if len(image) == 1:
                single[ch] = image
            elif image:
                longer[ch] = image
            else:
                gone.append(ch)
    listed = _NEXT.join(f"{ch}{_GIVES}{image}" for ch, image in longer.items())
    # what has no image stands last: translate removes it
    return "".join([*single, *gone]), "".join(single.values()), "".join(longer), listed


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def ascii_upper(text: Column) -> Column:
    """Accent-free upper case: the compatibility decomposition without combining marks.

    Marks go and characters with a one-character image are replaced in one
    pass; each distinct character left that has a longer image is spelled out.
    """
    source, images, spelled_out, listed = _fold_tables()
    folded = F.translate(text, source, images)
    table = F.str_to_map(F.lit(listed), F.lit(_NEXT), F.lit(_GIVES))
    # few texts hold such a character; for the others nothing below is looked up
    rest = F.array_distinct(F.split(F.regexp_replace(folded, r"[\x00-\x7F]+", ""), ""))
    rest = F.filter(rest, lambda ch: (ch != "") & F.contains(F.lit(spelled_out), ch))
    spelled = F.aggregate(rest, folded, lambda done, ch: F.replace(done, ch, table[ch]))
    return F.when(is_ascii(text), F.upper(text)).when(is_ascii(folded), folded).otherwise(spelled)


@lru_cache(maxsize=1)
def _alnum_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Non-ASCII characters whose folded form holds A-Z or 0-9.

    Folding works character by character, so the table is derived from the
    Unicode rule itself. Planes above 0x1FFFF decompose only to ideographs.
    Returns (one-character images, longer images).
    """
    single: dict[str, str] = {}
    longer: dict[str, str] = {}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        image = "".join(c for c in _fold(ch) if c.isascii() and c.isalnum())
        if len(image) == 1:
            single[ch] = image
        elif image:
            longer[ch] = image
    return single, longer


def normalize_identifier(text: Column) -> Column:
    """Folded text reduced to ``[A-Z0-9]``, without leaving the JVM."""
    single, longer = _alnum_tables()
    folded = F.translate(text, "".join(single), "".join(single.values()))
    listed = ";".join(f"{ch}={image}" for ch, image in longer.items())
    images = F.str_to_map(F.lit(listed), F.lit(";"), F.lit("="))
    # what is left beyond ASCII is replaced once per distinct character
    left = F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    spelled = F.aggregate(
        left, folded, lambda done, ch: F.replace(done, ch, F.coalesce(images[ch], F.lit("")))
    )
    plain = F.when(is_ascii(text), text).when(is_ascii(folded), folded).otherwise(spelled)
    return F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]+", ""))


def digit_signature(text: Column) -> Column:
    """All decimal digits of the text, in order."""
    return F.regexp_replace(text, r"\P{Nd}+", "")


def safe_reference(value: Column, pepper: str) -> Column:
    """Stable pseudonym: first 12 hex digits of a peppered SHA-256."""
    digest = F.sha2(F.concat(F.lit(pepper), F.lit(":"), value), 256)
    return F.concat(F.lit("ref_"), F.substring(digest, 1, 12))


def strip_whitespace(text: Column) -> Column:
    """Trim Unicode white space; ``trim`` would leave tabs and the like."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
