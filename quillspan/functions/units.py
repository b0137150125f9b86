"""Units and comparative words of typed quantities: static tables."""

from __future__ import annotations

CURRENCIES = {
    "SEK": ["sek", "kr", ":-", "kronor", "krona"], "NOK": ["nok", "kr", "kroner", "krone"], "DKK": ["dkk", "kr", "kroner", "krone"],
    "USD": ["usd", "$", "us$", "dollar", "dollars"], "EUR": ["eur", "€", "euro", "euros"], "GBP": ["gbp", "£", "pound", "pounds"],
    "JPY": ["jpy", "¥", "yen"], "CHF": ["chf", "francs", "franc"], "CAD": ["cad", "ca$"], "AUD": ["aud", "a$"], "INR": ["inr", "₹", "rupees", "rupee"],
    "PLN": ["pln", "zł"], "CZK": ["czk", "kč"], "KRW": ["krw", "₩"], "CNY": ["cny", "yuan"], "BRL": ["brl", "r$"],
}
MEASURES = {
    "kilogram": ["kg", "kilogram", "kilograms", "kilo", "kilos"], "gram": ["g", "gram", "grams"], "meter": ["m", "meter", "meters", "metre", "metres"],
    "centimeter": ["cm", "centimeter", "centimeters", "centimetre", "centimetres"], "millimeter": ["mm", "millimeter", "millimeters"], "kilometer": ["km", "kilometer", "kilometers"],
    "liter": ["l", "liter", "liters", "litre", "litres"], "milliliter": ["ml", "milliliter", "milliliters"], "gigabyte": ["gb", "gigabyte", "gigabytes"], "megabyte": ["mb", "megabyte", "megabytes"],
    "terabyte": ["tb", "terabyte", "terabytes"], "percent": ["%", "percent"], "inch": ["in", "inch", "inches", '"'], "foot": ["ft", "foot", "feet"], "watt": ["w", "watt", "watts"], "hour": ["h", "hour", "hours"], "minute": ["min", "minute", "minutes"], "celsius": ["°c"],
}
#: phrases that turn a number into a bound, longest first within a language
COMPARATIVES = {
    "en": {"lt": ["less than", "cheaper than", "under", "below"], "lte": ["at most", "up to", "maximum", "max"], "gt": ["more than", "over", "above"], "gte": ["at least", "minimum", "min", "from"]},
    "sv": {"lt": ["mindre än", "billigare än", "under"], "lte": ["högst", "upp till", "max"], "gt": ["mer än", "över"], "gte": ["minst", "från", "min"]},
    "de": {"lt": ["weniger als", "billiger als", "unter"], "lte": ["höchstens", "bis zu", "maximal", "max"], "gt": ["mehr als", "über"], "gte": ["mindestens", "ab", "min"]},
    "fr": {"lt": ["moins de", "moins cher que", "sous"], "lte": ["au plus", "jusqu'à", "maximum", "max"], "gt": ["plus de"], "gte": ["au moins", "à partir de", "minimum", "min"]},
    "es": {"lt": ["menos de", "por debajo de", "bajo"], "lte": ["como máximo", "hasta", "máximo", "max"], "gt": ["más de"], "gte": ["al menos", "desde", "mínimo", "min"]},
    "no": {"lt": ["mindre enn", "billigere enn", "under"], "lte": ["høyst", "opptil", "maks", "max"], "gt": ["mer enn", "over"], "gte": ["minst", "fra", "min"]},
    "da": {"lt": ["mindre end", "billigere end", "under"], "lte": ["højst", "op til", "maks", "max"], "gt": ["mere end", "over"], "gte": ["mindst", "fra", "min"]},
    "nl": {"lt": ["minder dan", "goedkoper dan", "onder"], "lte": ["hoogstens", "tot", "maximaal", "max"], "gt": ["meer dan", "boven"], "gte": ["minstens", "vanaf", "min"]},
    "it": {"lt": ["meno di", "sotto"], "lte": ["al massimo", "fino a", "massimo", "max"], "gt": ["più di", "oltre"], "gte": ["almeno", "da", "minimo", "min"]},
    "pt": {"lt": ["menos de", "abaixo de"], "lte": ["no máximo", "até", "máximo", "max"], "gt": ["mais de", "acima de"], "gte": ["pelo menos", "desde", "mínimo", "min"]},
    "fi": {"lt": ["alle", "vähemmän kuin"], "lte": ["enintään", "max"], "gt": ["yli", "enemmän kuin"], "gte": ["vähintään", "alkaen", "min"]},
}
BETWEEN = {"en": ("between", "and", "to"), "sv": ("mellan", "och", "till"), "de": ("zwischen", "und", "bis"), "fr": ("entre", "et", "à"), "es": ("entre", "y", "a"), "no": ("mellom", "og", "til"), "da": ("mellem", "og", "til"), "nl": ("tussen", "en", "tot"), "it": ("tra", "e", "a"), "pt": ("entre", "e", "a"), "fi": ("välillä", "ja", "-")}


def spellings(unit: str) -> list[str]:
    """How a unit is typed, folded; a unit no table has stands for its own text."""
    return CURRENCIES.get(unit.upper()) or MEASURES.get(unit.lower()) or [unit.lower()]


def is_currency(unit: str) -> bool:
    return unit.upper() in CURRENCIES
