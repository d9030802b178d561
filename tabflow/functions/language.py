"""Names and signs of the formula language, by locale."""

from __future__ import annotations

from dataclasses import dataclass

# Each function's id with its English and its Dutch name (None: it has none
# in that locale; ids in parentheses in EXTRA_NAMES below are reachable by our own names).
ENGLISH: dict[str, str | None] = {
    "upper": "UPPER", "lower": "LOWER", "negate": "NEGATE", "identity": None, "abs": "ABS", "and": "AND", "or": "OR", "xor": "XOR",
    "if": "IF", "concat": "CONCAT", "cos": "COS", "sin": "SIN", "tan": "TAN", "cosh": "COSH", "sinh": "SINH", "tanh": "TANH",
    "acos": "ACOS", "asin": "ASIN", "atan": "ATAN", "sqrt": "SQRT", "left": "LEFT", "right": "RIGHT", "mid": "MID", "length": "LENGTH",
    "log": "LOG", "not": "NOT", "substitute": "REPLACE", "trim": "TRIM", "coalesce": "COALESCE", "iferror": "IFERROR", "count": "COUNT",
    "sum": "SUM", "average": "AVERAGE", "min": "MIN", "max": "MAX", "randomItem": None, "countAll": "COUNTA", "pack": "PACK.VALUES",
    "exp": "EXP", "ln": "LN", "round": "ROUND", "choose": "CHOOSE", "randomBetween": "RANDBETWEEN", "random": "RAND",
    "regexSubstitute": "REPLACE.PATTERN", "normalInverse": "NORM.INV", "sign": "SIGN", "split": "SPLIT", "nth": None, "items": "ITEMS",
    "levenshtein": "SIMILARITY", "urlencode": "ENCODEURL", "in": "IN", "notIn": "NOT.IN", "capitalize": "PROPER", "now": "NOW",
    "fromUnix": "FROM.UNIX", "toUnix": "TO.UNIX", "fromISO8601": "FROM.ISO8601", "toLocalISO8601": "TO.ISO8601",
    "toUTCISO8601": "TO.ISO8601.UTC", "fromExcelDate": "FROM.EXCELDATE", "toExcelDate": "TO.EXCELDATE", "date": "DATE.UTC",
    "day": "DAY.UTC", "month": "MONTH.UTC", "year": "YEAR.UTC", "minute": "MINUTE.UTC", "hour": "HOUR.UTC", "second": "SECOND.UTC",
    "duration": "DURATION", "after": "AFTER", "ceiling": "CEILING", "floor": "FLOOR", "randomString": "RANDSTRING",
    "fromUnicodeDateString": "READ.DATE", "toUnicodeDateString": "WRITE.DATE", "power": "POWER", "uuid": "UUID", "countDistinct": None,
    "medianLow": "MEDIAN.LOW", "medianHigh": "MEDIAN.HIGH", "median": "MEDIAN", "medianPack": "MEDIAN.PACK", "variancePopulation": "VAR.P",
    "varianceSample": "VAR.S", "stdevPopulation": "STDEV.P", "stdevSample": "STDEV.S", "isEmpty": None, "isInvalid": None,
    "jsonArrayToPack": "FROM.JSON", "parseNumber": "READ.NUMBER", "valueForKey": None, "hilbertXYtoD": "HILBERT.D",
    "hilbertDtoX": "HILBERT.X", "hilbertDtoY": "HILBERT.Y", "powerDown": "POWER.DOWN", "powerUp": "POWER.UP",
    "base64Encode": "BASE64.ENCODE", "base64Decode": "BASE64.DECODE", "hexEncode": "HEX.ENCODE", "hexDecode": "HEX.DECODE",
    "numberOfBytes": "SIZE.OF", "encodeString": "ENCODE", "decodeString": "DECODE", "list": "LIST", "jsonEncode": "TO.JSON",
    "packList": "PACK", "glue": "GLUE", "unpackList": "UNPACK", "appendValueToList": "APPEND", "appendList": "APPEND.LIST",
}
DUTCH: dict[str, str | None] = {
    "upper": "HOOFDLETTERS", "lower": "KLEINE.LETTERS", "negate": "OMKEREN", "identity": None, "abs": "ABS", "and": "EN", "or": "OF",
    "xor": "EX.OF", "if": "ALS", "concat": "TEKST.SAMENVOEGEN", "cos": "COS", "sin": "SIN", "tan": "TAN", "cosh": "COSH", "sinh": "SINH",
    "tanh": "TANH", "acos": "BOOGCOS", "asin": "BOOGSIN", "atan": "BOOGTAN", "sqrt": "WORTEL", "left": "LINKS", "right": "RECHTS",
    "mid": "DEEL", "length": "LENGTE", "log": "LOG", "not": "NIET", "substitute": "SUBSTITUEREN", "trim": "SPATIES.WISSEN",
    "coalesce": "EERSTE.GELDIG", "iferror": "ALS.FOUT", "count": "AANTAL", "sum": "SOM", "average": "GEMIDDELDE", "min": "MIN",
    "max": "MAX", "randomItem": None, "countAll": "AANTALARG", "pack": "WAARDEN.INPAKKEN", "exp": "EXP", "ln": "LN", "round": "AFRONDEN",
    "choose": "KIEZEN", "randomBetween": "ASELECTTUSSEN", "random": "ASELECT", "regexSubstitute": "SUBSTITUEREN.PATROON",
    "normalInverse": "NORM.INV.N", "sign": "POS.NEG", "split": "SPLITS", "nth": None, "items": "ITEMS", "levenshtein": "GELIJKENIS",
    "urlencode": "URL.CODEREN", "in": "IN", "notIn": "NIET.IN", "capitalize": "BEGINLETTERS", "now": "NU", "fromUnix": "VAN.UNIX",
    "toUnix": "NAAR.UNIX", "fromISO8601": "VAN.ISO8601", "toLocalISO8601": "NAAR.ISO8601", "toUTCISO8601": "NAAR.ISO8601.UTC",
    "fromExcelDate": "VAN.EXCELDATUM", "toExcelDate": "NAAR.EXCELDATUM", "date": "DATUM.UTC", "day": "DAG.UTC", "month": "MAAND.UTC",
    "year": "JAAR.UTC", "minute": "MINUUT.UTC", "hour": "UUR.UTC", "second": "SECONDE.UTC", "duration": "TIJDSDUUR", "after": "NA",
    "ceiling": "AFRONDEN.BOVEN", "floor": "AFRONDEN.BENEDEN", "randomString": "ASELECTTEKST", "fromUnicodeDateString": "LEES.DATUM",
    "toUnicodeDateString": "SCHRIJF.DATUM", "power": "MACHT", "uuid": "UUID", "countDistinct": "AANTAL.UNIEK",
    "medianLow": "MEDIAAN.LAAG", "medianHigh": "MEDIAAN.HOOG", "median": "MEDIAAN", "medianPack": "MEDIAAN.PAKKET",
    "variancePopulation": "VAR.P", "varianceSample": "VAR.S", "stdevPopulation": "STDEV.P", "stdevSample": "STDEV.S", "isEmpty": None,
    "isInvalid": None, "jsonArrayToPack": "VAN.JSON", "parseNumber": "LEES.GETAL", "valueForKey": None, "hilbertXYtoD": "HILBERT.D",
    "hilbertDtoX": "HILBERT.X", "hilbertDtoY": "HILBERT.Y", "powerDown": "MACHT.OMLAAG", "powerUp": "MACHT.OMHOOG",
    "base64Encode": "BASE64.ENCODEREN", "base64Decode": "BASE64.DECODEREN", "hexEncode": "HEX.ENCODEREN", "hexDecode": "HEX.DECODEREN",
    "numberOfBytes": "GROOTTE.VAN", "encodeString": "ENCODEREN", "decodeString": "DECODEREN", "list": "LIJST", "jsonEncode": "NAAR.JSON",
    "packList": "INPAKKEN", "glue": "LIJMEN", "unpackList": "UITPAKKEN", "appendValueToList": "INVOEGEN", "appendList": "INVOEGEN.LIJST",
}
#: Second names, and names of our own for functions that had none.
ENGLISH_ALIASES = {"SMALL": "min", "LARGE": "max"}
DUTCH_ALIASES = {"KLEINSTE": "min", "GROOTSTE": "max"}
OWN_NAMES = {"IDENTITY": "identity", "ISEMPTY": "isEmpty", "ISINVALID": "isInvalid", "COUNTDISTINCT": "countDistinct", "RANDITEM": "randomItem", "NTH": "nth", "VALUEFORKEY": "valueForKey"}

#: Number postfixes (fixed values): decimal and binary multiples, parts of a hundred and so on.
POSTFIXES: dict[str, float] = {
    "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Z": 1e21, "Y": 1e24,
    "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24,
    "Ki": 1024.0, "Mi": 1024.0**2, "Gi": 1024.0**3, "Ti": 1024.0**4, "%": 1e-2, "‰": 1e-3, "‱": 1e-4,
}


@dataclass(frozen=True)
class Language:
    """One locale's names and separators."""

    code: str
    names: dict[str, str | None]
    aliases: dict[str, str]
    constants: dict[str, object]
    decimal: str
    grouping: str
    time_zone: str = "UTC"

    @property
    def functions(self) -> dict[str, str]:
        """Function ids by upper-case name."""
        return OWN_NAMES | self.aliases | {n.upper(): i for i, n in self.names.items() if n}

    def name_of(self, function: str) -> str:
        return self.names.get(function) or next(n for n, i in self.functions.items() if i == function)


ERROR = object()  # the constant that is invalid
PI = 3.141592654  # fixed value
LANGUAGES = {
    "en": Language("en", ENGLISH, ENGLISH_ALIASES, {"TRUE": True, "FALSE": False, "PI": PI, "NULL": None, "ERROR": ERROR}, ".", ","),
    "nl": Language("nl", DUTCH, DUTCH_ALIASES, {"WAAR": True, "ONWAAR": False, "PI": PI, "LEEG": None, "FOUT": ERROR}, ",", "."),
}
