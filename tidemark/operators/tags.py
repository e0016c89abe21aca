"""Currency tags of market texts, the entries of idea logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text import shouty

# Currency codes, currencies of two-letter country codes, names of currencies (as patterns, in the order in
# which they are looked for), symbols, and codes that are also words.
CODES = [
    "USD", "EUR", "GBP", "JPY", "CHF", "AUD", "NZD", "CAD", "CNY", "CNH", "KRW", "INR", "IDR", "BRL", "MXN", "ZAR", "TRY", "HUF",
    "PLN", "CZK", "SEK", "NOK", "THB", "TWD", "MYR", "PHP", "SGD", "HKD", "ILS", "RUB", "COP", "PEN", "UYU", "ARS", "CLP",
]
COUNTRIES = {
    "US": "USD", "GB": "GBP", "UK": "GBP", "JN": "JPY", "JP": "JPY", "EC": "EUR", "EU": "EUR", "GE": "EUR", "FR": "EUR", "IT": "EUR", "SP": "EUR", "AU": "AUD", "NZ": "NZD", "CA": "CAD", "SZ": "CHF",
    "CH": "CHF", "CN": "CNY", "KO": "KRW", "KR": "KRW", "IN": "INR", "ID": "IDR", "BZ": "BRL", "BR": "BRL", "MX": "MXN", "SA": "ZAR", "TU": "TRY", "TR": "TRY", "HU": "HUF", "PO": "PLN", "PL": "PLN",
    "CZ": "CZK", "SW": "SEK", "SE": "SEK", "NO": "NOK", "TH": "THB", "TA": "TWD", "TW": "TWD", "MA": "MYR", "MY": "MYR", "PH": "PHP", "SI": "SGD", "SG": "SGD", "HK": "HKD", "IS": "ILS", "RU": "RUB",
    "PE": "PEN", "AR": "ARS", "UR": "UYU", "CL": "CLP", "CO": "COP",
}
NAMES = {
    "GBP": ["cable", "sterling", "gilts?", "SONIA", "BoE", "pound"],
    "EUR": ["euro", "ECB", "Bund", "Euribor", "eurozone"],
    "JPY": ["yen", "BoJ", "MoF", "Tokyo fix"],
    "USD": ["dollar", "greenback", "DXY", "Fed", "FOMC", "SOFR", "treasur(?:y|ies)"],
    "CHF": ["swiss franc", "swissy", "SNB"],
    "KRW": ["korea", "seoul", "BoK", "KOSPI"],
    "CNY": ["china", "yuan", "renminbi", "PBoC"],
    "AUD": ["aussie", "RBA"],
    "NZD": ["kiwi", "RBNZ"],
    "CAD": ["loonie"],
    "SEK": ["riksbank", "krona"],
    "NOK": ["norges bank"],
    "MXN": ["banxico"],
    "BRL": ["brazil"],
    "INR": ["RBI", "rupee"],
    "TRY": ["CBRT", "lira"],
    "ZAR": ["SARB", "rand"],
    "PLN": ["zloty"],
    "HUF": ["forint"],
    "CZK": ["koruna"],
    "SGD": ["MAS", "singapore"],
    "HKD": ["HKMA", "hong kong"],
    "THB": ["baht"],
    "MYR": ["ringgit"],
    "PHP": ["BSP"],
    "ILS": ["shekel"],
    "TWD": ["taiwan"],
    "IDR": ["indonesia"],
}
SYMBOLS = {"£": "GBP", "€": "EUR", "¥": "JPY"}
WORDS = ("TRY", "COP", "PEN", "PHP")

_ANY = "|".join(CODES)
_SLASHED = r"(?U)\b[A-Za-z]{3}[/\-][A-Za-z]{3}\b"
_COMPACT = rf"(?U)\b(?=[A-Za-z]{{6}}\b)(?i:{_ANY})(?i:{_ANY})\b"


def _legs(pairs: Column, second: int) -> Column:
    """Both codes of each pair, the second from that place on."""
    legs = F.transform(pairs, lambda p: F.array(F.upper(F.substring(p, 1, 3)), F.upper(F.substring(p, second, 3))))
    known = F.array(*map(F.lit, CODES))
    return F.flatten(F.filter(legs, lambda x: F.array_contains(known, x[0]) & F.array_contains(known, x[1])))


def currencies(text: Column) -> Column:
    """Currencies of a text without repeats, the primary one first; none of a null text.

    In this order: codes in braces (unknown ones as they are), slashed pairs, compact pairs, codes alone in upper case,
    names, BI, symbols.  Text of a pair counts for the pair only.  CNH becomes CNY and goes to the end.  A dollar alone
    needs no further evidence, since its code is its own.
    """
    t = F.coalesce(text, F.lit(""))
    country = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    braces = F.transform(F.regexp_extract_all(t, F.lit(r"\{([A-Za-z]{2})\}"), 1), lambda c: F.coalesce(F.try_element_at(country, F.upper(c)), F.upper(c)))
    slashed = _legs(F.regexp_extract_all(t, F.lit(_SLASHED), 0), 5)
    # All that looks like a pair is marked from left to right, as an unknown one uses up its text; then known ones go.
    marked = F.regexp_replace(t, _SLASHED, "\u0001$0\u0002")
    rest = F.regexp_replace(F.regexp_replace(marked, f"\u0001(?i:{_ANY})[/\\-](?i:{_ANY})\u0002", " "), "[\u0001\u0002]", "")
    compact = _legs(F.regexp_extract_all(rest, F.lit(_COMPACT), 0), 4)
    alone = F.regexp_extract_all(F.regexp_replace(rest, _COMPACT, " "), F.lit(rf"(?U)\b(?:{_ANY})\b"), 0)
    alone = F.filter(alone, lambda c: ~(shouty(t) & c.isin(*WORDS)))
    named = [F.when(t.rlike(rf"(?iU)\b(?:{'|'.join(words)})\b"), code) for code, words in NAMES.items()]
    bank = F.when(F.regexp_replace(t, r"(?iU)\bbi-weekly\b", "").rlike(r"(?U)\bBI\b"), "IDR")
    symbols = [F.when(t.contains(s), code) for s, code in SYMBOLS.items()]
    found = F.array_distinct(F.concat(braces, slashed, compact, alone, F.array_compact(F.array(*named, bank, *symbols))))
    onshore = F.array_distinct(F.array_append(F.array_remove(found, "CNH"), F.lit("CNY")))
    return F.when(F.array_contains(found, "CNH"), onshore).otherwise(found)


def ideas(logs: DataFrame, column: str, having: Mapping[str, str] | None = None, tag: str | None = None, tags: str = "tags") -> DataFrame:
    """One row per entry of nested logs (an array of days, each with `entries`), with the day's other fields.

    `having` names fields and the values they must have; `tag` must be among an entry's tags, in any case.
    """
    days = logs.select(F.explode(column).alias("day"))
    fields = [f for f in days.schema["day"].dataType.names if f != "entries"]
    rows = days.select(*(F.col(f"day.{f}").alias(f) for f in fields), F.explode("day.entries").alias("entry")).select(*fields, "entry.*")
    for field, value in (having or {}).items():
        rows = rows.filter(F.col(field) == value)
    return rows if tag is None else rows.filter(F.exists(tags, lambda x: F.upper(x) == tag.upper()))
