"""Rule tables: ordered patterns that several expressions and their SQL share.

Patterns use no look-around and only classes that Java and RE2 read alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import label_tables as L

# Border characters, decimal separators and unit confusions of OCR output.
BORDER = "|{}[]\\"
DECIMAL = [(r"([0-9]),([0-9])", "$1.$2"), (r"([0-9])'([0-9])", "$1.$2")]
UNIT_FIXES = [(r"\bm9\b", "mg", "m9"), (r"pg\b", "µg", "pg"), (r"Ug\b", "µg", "Ug"), (r"\bug\b", "µg", "ug")]
# Targeted fixes of frequent misreadings, applied in order, each to what the one before left.
TARGETED = [
    (r"\bO([0-9]{2,})", "0$1"),
    (r"([0-9])O([0-9])", "$10$2"),
    (r"([0-9])[lI]([0-9])", "$11$2"),
    (r"(?i)([0-9]+[.,]?[0-9]*)\s*m0\b", "$1mg"),
    (r"(?i)([0-9]+[.,]?[0-9]*)\s*M9\b", "$1mg"),
    (r"([0-9]+[.,]?[0-9]*)\s*K[Jj]\b", "$1kJ"),
    (r"(?i)([0-9]+[.,]?[0-9]*)\s*[Kk]ca[il]\b", "$1kcal"),
    (r"^k[Jj]$", "kJ"),
    (r"(?i)^[Kk]ca[il]$", "kcal"),
    (r"^[Mm]cg$", "µg"),
    (r"(?i)^[Kk][Jj]/[Kk]ca[il]$", "kJ/kcal"),
    (r"(?i)^Magnes[il]um$", "Magnesium"),
    (r"(?i)^Magnesiu[mn]$", "Magnesium"),
    (r"(?i)^[HM]agnesium$", "Magnesium"),
    (r"(?i)^Calc[il]um$", "Calcium"),
    (r"(?i)^Kalz[il]um$", "Kalzium"),
    (r"(?i)^V[il]tam[il]n$", "Vitamin"),
    (r"(?i)^V[il]tamin$", "Vitamin"),
    (r"(?i)^Natr[il]um$", "Natrium"),
    (r"(?i)^Koh[il]enhydrate?$", "Kohlenhydrate"),
    (r"(?i)^Energ[il]e[il]?$", "Energie"),
    (r"(?i)^Ba[il]{1,2}aststoffe$", "Ballaststoffe"),
    (r"(?i)^E[il]we[il][sßb]{1,2}$", "Eiweiss"),
    (r"(?i)^Fettsaure[mn]?$", "Fettsauren"),
    (r"(?i)^N[il]ac[il]n$", "Niacin"),
    (r"(?i)^B[il]ot[il]n$", "Biotin"),
    (r"(?i)^Fo[il]s[aä]ure$", "Folsaure"),
    (r"(?i)^Pantothensaure$", "Pantothensaure"),
    (r"(?i)^R[il]bofla[vi][il]n$", "Riboflavin"),
    (r"(?i)^Ph[o0]sph[o0]r$", "Phosphor"),
    (r"(?i)^Th[il]am[il]n$", "Thiamin"),
    (r"(?i)^J[o0]d$", "Jod"),
]
# The first level of the text corrector, in order, whatever the case.
FIRST_LEVEL = [("(?i)" + p, r) for p, r in (
    (r"\bHagnesium\b", "Magnesium"), (r"\bMagnesiunn\b", "Magnesium"), (r"\bMagnes[il]um\b", "Magnesium"), (r"\bMagnesiu[mn]\b", "Magnesium"),
    (r"\bKalumciuat\b", "Kaliumcitrat"), (r"\bKalumc[il]uat\b", "Kaliumcitrat"), (r"\bCalc[il]um\b", "Calcium"), (r"\bKalz[il]um\b", "Kalzium"),
    (r"\bV[il]tam[il]n\b", "Vitamin"), (r"\bV[il]tamin\b", "Vitamin"), (r"\bEnerg[il]e[il]\b", "Energie"), (r"\bEnerg[il]e\b", "Energie"),
    (r"\bE[il]we[il][sß][sß]\b", "Eiweiß"), (r"\bE[il]we[il]ß\b", "Eiweiß"), (r"\bKoh[il]enhydrate\b", "Kohlenhydrate"), (r"\bKoh[il]enhydrat\b", "Kohlenhydrate"),
    (r"\bFettsauren\b", "Fettsäuren"), (r"\bFettsäure[mn]\b", "Fettsäuren"), (r"\bBa[il][il]aststoffe\b", "Ballaststoffe"), (r"\bSa[il]z[Il|][sS]a[il]t\b", "Salz/Salt"),
    (r"\bSa[il]z[Il]\b", "Salz"), (r"\bNatr[il]um\b", "Natrium"), (r"\bPhosphor\b", "Phosphor"), (r"\bPhosph0r\b", "Phosphor"), (r"\bN[il]ac[il]n\b", "Niacin"), (r"\bB[il]ot[il]n\b", "Biotin"),
    (r"\bFo[il]säure\b", "Folsäure"), (r"\bFo[il]saure\b", "Folsäure"), (r"\bPantothensaure\b", "Pantothensäure"), (r"\b4O([0-9])", "40$1"), (r"\bO([0-9]{2,})", "0$1"), (r"([0-9])O([0-9])", "$10$2"),
    (r"([0-9])l([0-9])", "$11$2"), (r"\bmg\s*[|}\]]+", "mg"), (r"\bg\s*[|}\]]+", "g"), (r"\bk[Jj]\b", "kJ"), (r"\bKca[il]\b", "kcal"), (r"\bKCa[il]\b", "kcal"), (r"\bUg\b", "µg"), (r"\bug\b", "µg"),
    (r"\bMcg\b", "µg"), (r"\bmcg\b", "µg"), ("^['\"'`]+", ""), ("['\"'`]+$", ""), (r"[|}\]]+$", ""), (r"^[|{\[]+", ""), (r"([0-9]+)\s*m0\b", "$1mg"), (r"([0-9]+)\s*M9\b", "$1mg"),
    (r"([0-9]+)\s*m\b", "$1mg"), (r"([0-9]+)\s*K[Jj]\b", "$1kJ"), (r"([0-9]+)\s*Kcal\b", "$1kcal"), (r"^([0-9]+[.,]?[0-9]*)\s*µ$", "$1µg"), (r"^([0-9]+[.,]?[0-9]*)\s*μ$", "$1µg"),
)]
# Context headers.
CONTEXT_100G = r"^(je|pro|pr0)\s*100\s*g?(\s+.*)?$"
CONTEXT_100ML = r"^per\s*100\s*ml$"
CONTEXT_10G = r"^(pro|pr0)\s*10\s*g\*{0,2}$"
# Fused tokens.
ENERGY_WORD = r"^(ENERGIE)(KJ|LW)(/KCAL|KCAL)?$"
ENERGY_PAIR = r"^([0-9]+[.,]?[0-9]*)\s*(kj|kcal)\s*/\s*([0-9]+[.,]?[0-9]*)\s*(kj|kcal)$"
ENERGY_UNIT = r"^([0-9]+[.,]?[0-9]*)\s*(kj|kcal)\s*/?\s*$"
NUMBERS_SLASH = r"^([0-9]{2,}[.,]?[0-9]*)\s*/\s*([0-9]{2,}[.,]?[0-9]*)$"
FUSED = r"^([<>~]?[0-9]+\.?[0-9]*)\s*(µg(\s*(re|ne|te|α-te|a-te))?|mg(\s*(ne|re|α-te|a-te))?|ug|kj|kcal|ml|kg|iu|ie|kbe|cfu|g)$"
NRV_TAIL = r"\(?[0-9.,]+\s*%\)?[\s*³²¹⁾\)\]]*$"
PROTECTED = ("100g", "100 g", "100ml", "100 ml")

# The short corrector's literal replacements, in order, and numbers in powers of ten fused with a unit.
LITERALS = [("rn", "m"), ("Ug", "µg"), ("ug", "µg"), ("Hagnesium", "Magnesium"), ("Hagneslum", "Magnesium"), ("Calclum", "Calcium"), ("Selenlum", "Selenium")]
SCIENTIFIC = r"^([0-9]+[.,]?[0-9]*\s*[xX×]\s*10[\^⁰¹²³⁴⁵⁶⁷⁸⁹0-9]*)\s*(KBE|kbe|CFU|cfu|IU|iu|IE|ie)$"
# The contexts that gold rows may have.
VALID_CONTEXTS = ("per_100g", "per_serving", "per_daily_dose", "per_100ml")

# Token classes.
NRV = r"^\*?\s*[0-9]+[\s,.]?[0-9]*\s*%\s*\*?$"
SERVING = r"^[0-9]+\s*(kapseln?|tabletten?|softgels?|tubes?|sachets?|capsules?|tablets?|gummies?|drops?|stueck)$"
QUANTITY = r"^[<>]?\s*[*'\"]?([0-9]+[.,]?[0-9]*(\s*[x×]\s*10[0-9]*)?)\s*(mg|g|kg|µg|mcg|ug|kj|kcal|cal|ie|iu|%|ml|l)?[*'\"\s]*$"
UNIT_TAIL = r"\s*(kj|kcal|cal|mg|g|kg|µg|mcg|ug|μg|ml|l|ie|iu|ne|re|%)[/\s].*$"
VITAMIN = r"^(b[0-9]{1,2}|vitamin\s+[a-z][0-9]*|[cdek][0-9]?)$"
SINGLE_UNITS = ("g", "l")
#: Terms that the corrector and the text extractor know.
NUTRIENTS = ("energie", "brennwert", "fett", "eiweiss", "eiweiß", "protein", "kohlenhydrate", "zucker", "salz", "ballaststoffe", "calcium", "magnesium", "eisen", "zink", "natrium", "energy")
# Quantities of tuples.
QTY_UNIT = r"^([0-9]+[.,]?[0-9]*)\s*(mg|g|kg|µg|mcg|ug|kj|kcal|ml|iu|ie)$"
QTY_ENERGY = r"^([0-9]+[.,]?[0-9]*)\s*(kj|kcal)\s*[\(\[]"
QTY_PAREN = r"^([0-9]+[.,]?[0-9]*)\s*[\(\[]"
QTY_PLAIN = r"^([0-9]+[.,]?[0-9]*)$"
ENERGY_NAME = r"(energie|energy|brennwert|énergie|energia|energy\s*value|valor\s*energ|valeur\s*energ|valore\s*energ|wartość\s*energ|energetick|energijska)"
ENERGY_UNITS = ("kj", "kcal", "cal", "kj/kcal", "kj/kca", "kcal/kj")
EMBEDDED_UNIT = r"[\(\s/](kj/kcal|kj/kca|kcal/kj|kj|kcal|cal|mg\s*(ne|re|α-te|a-te)?|µg\s*(re|ne|te)?|mcg|ug|μg|kg|ml|dl|cl|ie|iu|kbe|cfu|g)\s*[\)\s,.:;]*$"
UNIT_ALIASES = {"ie": "iu", "i.e.": "iu", "cal": "kcal", "mcg": "µg", "ug": "µg"}
#: (name as printed, canonical name).
CANONICAL = [("eiweiß", "protein"), ("eiweiss", "protein"), ("fett", "fat"), ("brennwert", "energy"), ("energie", "energy"), ("kohlenhydrate", "carbohydrate"), ("zucker", "sugars"), ("salz", "salt"), ("eisen", "iron"), ("zink", "zinc"), ("ballaststoffe", "fibre")]
# Fixed values: (pattern, label) of suspicious tokens.
SUSPICIOUS = [
    (r"^[0-9]+09$", "trailing-digit artefact (09 suffix)"),
    (r"^[0-9]+\.[0-9]+9$", "trailing-digit artefact (decimal +9)"),
    (r"^[0-9]+19$", "trailing-digit artefact (19 suffix)"),
    (r"[0-9][',][0-9]", "apostrophe/comma as decimal separator"),
    (r"[0-9]+k[0-9]+", "fused kJ/kcal value"),
    (r"[A-Za-z]+kJ", "fused label+kJ unit"),
    (r"^[0-9]+[\.,][0-9]*[a-zA-Zµ]+$", "fused quantity+unit (decimal)"),
    (r"^[0-9]+[a-zA-Zµ]+$", "fused quantity+unit (integer)"),
    (r"(?i)Je[0-9]+", "fused context (Je+number -> je 100g?)"),
    (r"(?i)pro[0-9]+", "fused context (pro+number -> pro 100g?)"),
    (r"\*{2}", "PORTION** context token"),
    (r"[|{}\[\]\\]", "border/table artefact character"),
    (r"^[^a-zA-Z0-9µ.,]$", "single non-alphanumeric noise character"),
    (r"^Ug$|^ug$", "unit confusion: Ug/ug -> µg"),
    (r"(?:[A-Za-zÀ-ÿ]+/){3,}", "multilingual slash-variant (4+ parts)"),
    (r"[a-z][A-Z][a-z]", "possible fused tokens (camelCase boundary)"),
    (r"^[0-9]+[A-Za-z][0-9]+$", "letter embedded in number (OCR confusion)"),
]


def fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def duck_fold(text: str, rules: list[tuple[str, str]]) -> str:
    """The same as DuckDB SQL."""
    for pattern, to in rules:
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        text = f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"
    return text


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_of(words: Iterable[str]) -> str:
    """A pattern that finds a text holding any of the words; common beginnings are written once, so a letter that begins none is left at once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:
            return ""
        ways = [(c if c == " " else re.escape(c)) + pattern(next_) for c, next_ in sorted(at.items())]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return pattern(tree)


def either(patterns: Iterable[str]) -> str:
    """A pattern that finds a text in which any of the patterns is found: asked first, it spares most texts the single ones."""
    begin, other = [], []
    for p in patterns:
        flag, rest = ("?i:", p[4:]) if p.startswith("(?i)") else ("?:", p)
        (begin if rest.startswith("^") else other).append(f"({flag}{rest.removeprefix('^')})")
    # Patterns of whole texts are tried at the beginning only.
    return "|".join([f"^(?:{'|'.join(begin)})"] * bool(begin) + other)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each evaluated once a row however often the steps after read or filter by it."""
    made = F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return rows.select(*(c for c in rows.columns if c not in columns), made)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def duck_first_match(text: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p)}) THEN {q(v)}" for p, v in rules) + " END"


def unit_fixes(text: Column) -> Column:
    return fold(text, [(p, r) for p, r, _ in UNIT_FIXES])


def fold_letters(text: Column) -> Column:
    """Lower case without diacritics: a for ä, ss for ß."""
    return F.replace(F.translate(F.lower(text), "äöüáàâéèêíìîóòôúùûñç", "aouaaaeeeiiiooouuunc"), F.lit("ß"), F.lit("ss"))


def duck_fold_letters(text: str) -> str:
    return f"replace(translate(lower({text}), 'äöüáàâéèêíìîóòôúùûñç', 'aouaaaeeeiiiooouuunc'), 'ß', 'ss')"


def normal(text: Column) -> Column:
    """Lower case, no quotes, no (qualifier), single spaces, no outer punctuation."""
    s = F.trim(F.lower(text))
    # Most tokens have nothing to replace.
    r = F.regexp_replace(s, "['\"`]", "")
    r = F.regexp_replace(F.regexp_replace(r, r"\([a-zα-ω0-9-]+\)", ""), r"\s+", " ")
    return F.btrim(F.when(s.rlike("['\"`(\\s]"), r).otherwise(s), F.lit(".,!?;:- "))


def duck_normal(text: str) -> str:
    s = f"regexp_replace(trim(lower({text})), '[''\"`]', '', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\([a-zα-ω0-9-]+\\)', '', 'g'), '\\s+', ' ', 'g')"
    return f"trim({s}, '.,!?;:- ')"


_CONTEXT_TRIM = ".,;:*'\"()"
#: The leftmost string that makes a context, of several there the longest.
_CONTEXT_PART = "(" + "|".join(re.escape(p).replace("\\ ", " ") for p in sorted(L.CONTEXT_PARTS, key=lambda p: (-len(p), p))) + ")"
_FORMS = {form: name for name, forms in L.CONTEXT_FORMS.items() for form in forms}


def context(norm: Column, text: Column) -> Column:
    """Canonical context of a token, or null: its whole text, then without outer punctuation, then a string it holds, then patterns."""
    key = F.trim(F.lower(text))
    clean = F.btrim(key, F.lit(_CONTEXT_TRIM))
    # Few tokens can be a context; only those are looked at by the tables and single patterns, in the body of a lambda.
    may = key.isin(*_FORMS) | clean.isin(*_FORMS) | norm.rlike(_MAY_N) | clean.rlike(_MAY_C)
    seen = F.transform(F.array(F.struct(key.alias("key"), clean.alias("clean"), norm.alias("norm"))), lambda x: _context(x["key"], x["clean"], x["norm"]))
    return F.when(may, F.get(seen, F.lit(0)))


_MAY_N = either([any_of(L.CONTEXT_PARTS), *(p for on, p, _ in L.CONTEXT_PATTERNS if on == "n")])
_MAY_C = either(p for on, p, _ in L.CONTEXT_PATTERNS if on == "c")


def _context(key: Column, clean: Column, norm: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in _FORMS.items() for x in pair))
    form = lambda c: F.try_element_at(table, c)
    part = F.regexp_extract(norm, _CONTEXT_PART, 1)
    own = F.coalesce(form(norm), norm)
    out = F.lit(None).cast("string")
    for on, pattern, name in reversed(L.CONTEXT_PATTERNS):
        out = F.when({"c": clean, "n": norm}[on].rlike(pattern), F.lit(name) if name else own).otherwise(out)
    return F.coalesce(form(key), form(clean), F.when(part != "", F.coalesce(form(part), own)), out)


def duck_context(norm: str, text: str) -> str:
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in _FORMS.items()) + "}"
    form = lambda c: f"{table}[{c}]"
    key = f"trim(lower({text}))"
    clean = f"trim({key}, {q(_CONTEXT_TRIM)})"
    part = f"regexp_extract({norm}, {q(_CONTEXT_PART)}, 1)"
    own = f"coalesce({form(norm)}, {norm})"
    cases = " ".join(f"WHEN regexp_matches({dict(c=clean, n=norm)[on]}, {q(p)}) THEN {q(name) if name else own}" for on, p, name in L.CONTEXT_PATTERNS)
    return f"coalesce({form(key)}, {form(clean)}, CASE WHEN {part} <> '' THEN coalesce({form(part)}, {own}) END, CASE {cases} END)"
