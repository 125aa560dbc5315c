"""Contexts, units, names and noise of nutrition labels."""

from __future__ import annotations


def _lines(text: str) -> list[str]:
    return [line.strip() for part in text.strip().split("\n") for line in part.split(",") if line.strip()]


# Contexts as printed, by what they mean.
CONTEXT_FORMS = {
    "per_100g": _lines("""
        per 100g, per 100 g, per 100, per100g, je 100g, je 100 g, je100g, pro 100g, pro 100 g, pro100g, 100g, 100 g, je 1009, je1009, 1009, pr.100g, pr0100g
        pour 100g, pour 100 g, por 100g, por 100 g, por/na100g, pot/na100g, per 100g powder, per 100 g powder, je100g1portion12g, 100g1tube70g
    """),
    "per_100ml": _lines("per 100ml, per 100 ml, je 100ml, je 100 ml, pro 100ml, pro 100 ml, per100ml, 100ml"),
    "per_serving": _lines("""
        per serving, per portion, pro portion, pro portionl, pro portionll, per sachet, per tube, per capsule, per tablet, je kapsel, je tablette, pro kapsel, pro tablette
        per 1 tube, 1tube, pro 2 sticks, per 25g, pro 2 tabletten, je 700g, 1portion, pro 1 portion, pro esslöffel, pro essloffel, per scoop, pro schuss, per stick, pro stick
        per serve, per bar, portion**, pro port., pro port, proportion, perdrink, per drink, per piece, piece, pro stück, pro stueck, per stück, per stueck, je stück, stück, stueck
        75 g (300 ml), 75 g(300 ml), 75g (300ml), 75g(300ml), 75 g, 75g
    """),
    "per_daily_dose": _lines("""
        per daily dose, per tagesdosis, je tagesdosis, pro tagesdosis, per tagesration, je tagesration, 1tablette, 1 tablette, 2 tabletten, 3 tabletten, pro 3 tabletten
        pro 10g, je 10g, per 10g, tagesration, 1 tagesration, per daily, per daily diet, daily diet, shot, shots
    """),
}
# Strings that make a context of any text that holds them.
CONTEXT_PARTS = _lines("""
    per 100g, per 100 g, per 100ml, per 100 ml, je 100g, je 100 g, je 100ml, je 100 ml, pro 100g, pro 100 g, pro 100ml, pro 100 ml, per 100, per100g, per100ml, je100g, pro100g
    100g, 100 g, 100ml, 100 ml, je 1009, je1009, per serving, per portion, pro portion, per tube, per sachet, per capsule, per tablet, je kapsel, je tablette, je tagesdosis
    pro kapsel, pro tablette, pro tagesdosis, per daily dose, per tagesdosis, pro 2 sticks, pro 3 tabletten, pr.100g, pr0100g, pour 100g, pour 100 g, por 100g, por 100 g
    per 100g powder, per 100 g powder, per 25g, per 10g, je 10g, pro 10g, pro port., pro port, proportion, perdrink, per drink, per piece, per bar, tagesration, tagesdosis
    per stück, pro stück, per daily, daily diet, shot, shots
""")
# Fixed values: (text it is tried on, pattern, context) in order; c is the text without outer punctuation, n the normal form; None: the form of the table, or the normal form itself.
CONTEXT_PATTERNS = [
    ("c", r"^[0-9]+\s*(tablette|tabletten|kapsel|kapseln|softgel|softgels|ampulle|ampullen|flasche|flaschen|flask|flasks|stick|sticks|beutel|sachet|sachets|tropfen|drops|dragee|dragees|tagesration|tagesdosis|shot|shots|tube|tubes|riegel|caps\.?)", "per_daily_dose"),
    ("c", r"[0-9]+\s*(ampulle|ampullen|kapsel|kapseln|tablette|tabletten|flask|caps\.?|stick|sticks)", "per_daily_dose"),
    ("c", r"^(pro|per|je)\s+(stück|stueck|piece|riegel|bar)", "per_serving"),
    ("c", r"(per|pro|je)\s+(piece|stück|stueck|bar|riegel|serve|serving|portion)", "per_serving"),
    ("c", r"^(pro|per|je)\s+(esslöffel|essloffel|scoop|schuss|löffel)", "per_serving"),
    ("n", r"^(per|je|pro|fuer|pour|por|for)\s+[0-9]", None),
    ("n", r"^pr[o0.]?\s*100.*ml", "per_100ml"),
    ("n", r"^pr[o0.]?\s*100", "per_100g"),
    ("n", r"^pr[o0.]?\s*[0-9]+\s*(g|ml)\b", "per_serving"),
    ("n", r"^p[oa][rt]/na", "per_100g"),
    ("n", r"^(per|je|pro)\s+100\s*ml\s*(powder|pulver)?$", "per_100ml"),
    ("n", r"^(per|je|pro)\s+100\s*g\s*(powder|pulver)?$", "per_100g"),
]
# Units of measurement.
UNITS = tuple(_lines("mg, g, kg, µg, mcg, ug, μg, kj, kcal, cal, kj/kcal, kj kcal, kj/kca, kcal/kj, ml, dl, cl, l, ie, i.e., iu, i.u., kbe, cfu, mg ne, mg α-te, mg a-te, µg re, µg ne, µg te, mg/tag, µg/tag, g/tag, mg/day, µg/day, g/day"))
# Strings that make noise of any text that holds them.
NOISE = (
    "mindestens", "best before", "haltbar bis", "lot nr", "lot-nr", "charge", "batch", "mhd", "hergestellt", "manufactured", "vertrieb", "distributor", "verantwortlich", "responsible",
    "kontakt", "contact", "gmbh", " ag ", " kg ", "ltd", "inc.", "s.a.", "iso ", "haccp", "bio-siegel", "organic certified", "kuehl lagern", "trocken lagern", "store in", "keep away",
    "ausserhalb der reichweite", "nicht fuer kinder", "not for children", "verschlossen halten", "keep closed", "nach oeffnung", "after opening", "nutrition facts", "naehrwertangaben",
    "naehrwerttabelle", "nutritional information", "zutaten", "ingredients", "nrv", "nutrient reference", "naehrstoffbezugswert", "referenzwert", "empfohlene tagesdosis",
    "% der empfohlenen", "bezugswert", "daily value", "daily values", "percent daily", "based on a 2", "empfehlung", "verzehrempfehlung", "enthält", "contains", "zubereitung",
    "preparation", "anwendung", "dosierung", "dosage", "tabletten täglich", "kapseln täglich", "protein-riegel", "risiko einer", "entsprechend", "tragt bei zur", "beitragen zur",
)
# Names of nutrients; a text that holds one of five or more letters is one, so longer names that hold another are left out.
NAMES = tuple(_lines("""
    energie, brennwert, fett, fette, fettsauren, fettsäuren, davon gesattigte, davon gesättigte, kohlenhydrate, davon zucker, mehrwertige alkohole, ballaststoffe, eiweiss, eiweiß, salz
    natrium, kalium, kalzium, calcium, magnesium, phosphor, chlorid, fluorid, eisen, zink, jod, jodid, selen, kupfer, mangan, chrom, molybdän, molybdan, folsäure, folsaure
    pantothensäure, pantothensaure, thiamin, riboflavin, niacin, biotin, koffein, inositol, cholin, kreatin, liponsäure, liponsaure, rutin
    energy, fat, fats, saturated, saturates, carbohydrate, sugar, fibre, fiber, protein, salt, sodium, potassium, iron, zinc, iodine, copper, molybdenum, folic acid, pantothenic, caffeine, creatine
    énergie, graisses, matières grasses, lipides, dont acides gras saturés, dont acides gras satures, glucides, dont sucres, protéines, sel, valeur énergétique, valeur energetique
    koolhydraten, eiwitten, vetten, zout, vezels, verzadigde vetzuren, waarvan suikers, grassi, carboidrati, di cui zuccheri, sale, valore energetico
    grasas, de las cuales saturadas, hidratos de carbono, de los cuales azúcares, de los cuales azucares, proteínas, sal, valor energético, valor energetico
    vitamin, folat, cobalamin, ascorbic, ascorbinsäure, ascorbinsaure, tocopherol, retinol, cholecalciferol, colecalciferol, menaquinon, phylloquinon, pyridoxin
    omega, dha, epa, ala, linolsäure, linolsaure, linolensäure, linolensaure, leucin, valin, lysin, methionin, phenylalanin, threonin, tryptophan, histidin, l-lisina, l-istidina
    l-méthionine, l-metionin, l-fenilalanina, l-fenylalanin, l-thréonine, l-treonin, l-tryptofaan, l-triptófano, l-triptofano, l-tryptofan
    coenzym, coq10, carnitin, lutein, zeaxanthin, lycopin, astaxanthin, resveratrol, quercetin, lactobacillus, acidophilus, bifidobacterium, bifidum, eiweib, eweib
    green tea, greentea, melissen extrakt, melissenextrakt, melissa extract
"""))
