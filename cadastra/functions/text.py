"""Unicode functions that Spark lacks, as Arrow-batched functions for DataFrames and SQL."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Characters of code page 1252 that are not the code point of their byte.
CP1252 = {
    0x20AC: 0x80, 0x201A: 0x82, 0x0192: 0x83, 0x201E: 0x84, 0x2026: 0x85, 0x2020: 0x86, 0x2021: 0x87, 0x02C6: 0x88, 0x2030: 0x89,
    0x0160: 0x8A, 0x2039: 0x8B, 0x0152: 0x8C, 0x017D: 0x8E, 0x2018: 0x91, 0x2019: 0x92, 0x201C: 0x93, 0x201D: 0x94, 0x2022: 0x95,
    0x2013: 0x96, 0x2014: 0x97, 0x02DC: 0x98, 0x2122: 0x99, 0x0161: 0x9A, 0x203A: 0x9B, 0x0153: 0x9C, 0x017E: 0x9E, 0x0178: 0x9F,
}
# Patterns of UTF-8 bytes read as code page 1252, and of repairs that are not plausible Latin text.
_NEXT = "[\x80-\xbf" + "".join(chr(c) for c in sorted(CP1252)) + "]"
MOJIBAKE = f"[\xc2-\xdf]{_NEXT}|[\xe0-\xef]{_NEXT}{_NEXT}"
STRONG_MOJIBAKE = f"[\xc2\xc3]{_NEXT}|\xe2€|\xef\xbf\xbd|[\x80-\x9f]"
IMPLAUSIBLE = "[^\x20-\x7e\xa0-ɏḀ-ỿ‘-”–—€]|[\xa1-\xbf\xd7\xf7]"
# Format and control characters but for the joiners, and spaces other than the plain one.
INVISIBLE = "[­؜᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿\x00-\x08\x0e-\x1f\x7f]"
ODD_SPACE = "[\t\n\x0b\x0c\r\x85\xa0  -     　]"


def repair(text: str | None) -> str | None:
    """The text read again as UTF-8, or None unless every character is a byte and the result is plausible."""
    if text is None or not re.search(MOJIBAKE, text):
        return None
    try:
        out = bytes(CP1252.get(ord(c), ord(c)) for c in text).decode("utf-8")
    except ValueError:
        return None
    return None if re.search(IMPLAUSIBLE, out) else out


def clean(text: str | None) -> str | None:
    """Repaired, without invisible characters or odd spaces, NFC, single spaces, trimmed."""
    if text is None:
        return None
    text = repair(text) or text
    text = unicodedata.normalize("NFC", re.sub(INVISIBLE, "", re.sub(ODD_SPACE, " ", text)))
    return re.sub(" {2,}", " ", text).strip(" ")


def unaccented(text: str | None) -> str | None:
    if text is None:
        return None
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


def skeleton(text: str) -> str:
    """Letters and digits alone: a separator between two letters goes, any other is one space."""
    out: list[str] = []
    gap = False
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind not in "LMN":
            gap = True
            continue
        if gap and out and not (kind == "L" and unicodedata.category(out[-1])[0] in "LM"):
            out.append(" ")
        out.append(c)
        gap = False
    return "".join(out)


def _latin(text: str) -> bool:
    return all("LATIN" in unicodedata.name(c, "") or c in "ªº" for c in text if unicodedata.category(c)[0] == "L")


FORMS = ["cleaned", "composed", "repaired", "key", "loose", "plain"]


def forms(text: str) -> tuple:
    """(cleaned, composed, repaired, key, loose key, whether it is spelt without accents) of a name.

    The loose key has no accents if all letters are Latin.
    """
    composed, bare = unicodedata.normalize("NFC", text), unaccented(text)
    key = skeleton(composed.lower())
    return clean(text), composed, repair(text), key, skeleton(bare.lower()) if _latin(text) else key, bare == text


@F.pandas_udf(StructType([StructField(c, BooleanType() if c == "plain" else StringType()) for c in FORMS]))
def name_forms(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([forms(t) if t is not None else (None,) * len(FORMS) for t in x], columns=FORMS)


def visible(text: str | None) -> str | None:
    """Characters that can't be seen as their code points, for reports."""
    return None if text is None else re.sub(f"{INVISIBLE}|{ODD_SPACE}", lambda m: f"<U+{ord(m[0]):04X}>", text)


def _arrow(f):
    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore").astype(object).where(lambda s: s.notna(), None)

    return run


nfc = _arrow(lambda t: unicodedata.normalize("NFC", t))
strip_accents = _arrow(unaccented)
repair_mojibake = _arrow(repair)
clean_name = _arrow(clean)
visible_name = _arrow(visible)


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to SQL: nfc_normalize, strip_accents, name_repair_mojibake, name_clean."""
    for name, f in (("nfc_normalize", nfc), ("strip_accents", strip_accents), ("name_repair_mojibake", repair_mojibake), ("name_clean", clean_name)):
        spark.udf.register(name, f)
