"""Normalised wordings and the signatures that veto a match."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions.values import missing_text

# Words of materials whose difference tells two items apart.
MATERIAL_WORDS = ["stainless steel", "carbon steel", "steel", "brass", "bronze", "nylon", "aluminium", "copper", "plastic", "rubber", "titanium"]


@F.arrow_udf(T.StringType())
def _read(texts: pa.Array) -> pa.Array:
    """Texts of ASCII letters as :func:`fold` has them, all at once; of the others the accents dropped."""
    plain = pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(texts), "[^0-9a-z_]+", " "), " ")
    other = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if not pc.any(other).as_py():
        return plain
    bare = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts.filter(other).to_pylist()]
    return pc.replace_with_mask(plain, other, pa.array(bare, plain.type))


def fold(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores to single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Accents dropped after compatibility decomposition, then :func:`fold`; '' where nothing is said."""
    read = _read(text)
    return F.when(missing_text(text), "").when(F.octet_length(text) == F.length(text), read).otherwise(fold(read))


def normalise_plain(text: Column) -> Column:
    """:func:`normalise` without the decomposition, wholly on the JVM; equal for texts without accents."""
    return F.when(missing_text(text), "").otherwise(fold(text))


def digit_signature(text: Column) -> Column:
    """The sorted set of digit groups."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))))


def material_signature(text: Column, words: Sequence[str] = MATERIAL_WORDS) -> Column:
    """The sorted set of material words; longer phrases are looked for first and taken out once found."""
    rest = F.concat(F.lit(" "), text, F.lit(" "))
    hits = []
    for word in sorted(words, key=lambda w: (-len(w), w)):
        padded = f" {word} "
        hits.append(F.when(F.contains(rest, F.lit(padded)), F.lit(word)))
        rest = F.replace(rest, F.lit(padded), F.lit(" "))
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def signatures_differ(dl: Column, dr: Column, ml: Column, mr: Column) -> Column:
    """'digits' or 'material' if both sides have such a signature and they differ, digits first; else ''."""
    differ = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (a != b)
    return F.when(differ(dl, dr), "digits").when(differ(ml, mr), "material").otherwise("")


def disagreement(left: Column, right: Column, words: Sequence[str] = MATERIAL_WORDS) -> Column:
    """:func:`signatures_differ` of two texts."""
    return signatures_differ(digit_signature(left), digit_signature(right), material_signature(left, words), material_signature(right, words))
