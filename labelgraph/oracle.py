"""DuckDB SQL of the registered queries, built from shared common table expressions."""

from __future__ import annotations

from .functions import label_tables as L
from .functions import rules as R
from .functions.rules import q
from .sources.adapters import duck_tokens


def _in(values: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def tok(sql: str, *more: str, token: str | None = None) -> str:
    """``sql`` over the adapter's tokens; ``token`` is an expression that replaces their text."""
    replaced = [duck_tokens("tok0"), f"tok AS (SELECT * REPLACE ({token} AS token) FROM tok0)"] if token else [duck_tokens()]
    return "WITH RECURSIVE " + ",\n".join([*replaced, *more]) + "\n" + sql


# Correction


def rewrite(sql: str, token: str | None = None) -> str:
    low = "lower(token)"
    context = f"CASE WHEN regexp_matches({low}, {q(R.CONTEXT_100G)}) THEN CASE WHEN starts_with({low}, 'je') THEN 'je 100g' ELSE 'pro 100g' END WHEN regexp_matches({low}, {q(R.CONTEXT_100ML)}) THEN 'per 100ml' WHEN regexp_matches({low}, {q(R.CONTEXT_10G)}) THEN 'pro 10g' ELSE token END"
    steps = [("border", f"trim(trim(token, {q(R.BORDER)}))"), ("decimal", R.duck_fold("token", R.DECIMAL))]
    steps += [(f"unit_{n}", R.duck_fold("token", [(p, r)])) for p, r, n in R.UNIT_FIXES]
    steps += [("context", context), *((f"targeted_{i}", R.duck_fold("token", [r])) for i, r in enumerate(R.TARGETED))]
    ctes, at = ["r0 AS (SELECT *, token original, []::VARCHAR[] fired FROM tok)"], "r0"
    for i, (name, new) in enumerate(steps, 1):
        drop = " WHERE nw <> ''" if name == "border" else ""
        ctes.append(f"r{i} AS (SELECT image_id, tok_idx, original, nw token, CASE WHEN nw <> token THEN list_append(fired, {q(name)}) ELSE fired END fired FROM (SELECT *, {new} nw FROM {at}){drop})")
        at = f"r{i}"
    return tok(sql, *ctes, f"rw AS (SELECT * FROM {at})", token=token)


def split() -> str:
    g = lambda p, i, t="token": f"regexp_extract({t}, {q('(?i)' + p)}, {i})"
    num = lambda i: f"TRY_CAST(replace({g(R.NUMBERS_SLASH, i)}, ',', '.') AS DOUBLE)"
    lo = lambda p: f"regexp_matches(lower(token), {q(p)})"
    tail = f"CASE WHEN {lo(R.FUSED)} THEN token WHEN length(un) >= 2 AND regexp_matches(lower(un), {q(R.FUSED)}) THEN trim(un) END"
    parts = (
        f"CASE WHEN {lo(R.ENERGY_WORD.lower())} AND starts_with(upper(token), 'ENERGIELW') THEN ['ENERGIE'] WHEN {lo(R.ENERGY_WORD.lower())} THEN ['ENERGIE', substr(token, 8)]"
        f" WHEN {lo(R.ENERGY_PAIR)} THEN [{', '.join(g(R.ENERGY_PAIR, i) for i in (1, 2, 3, 4))}] WHEN {lo(R.ENERGY_UNIT)} THEN [{g(R.ENERGY_UNIT, 1)}, {g(R.ENERGY_UNIT, 2)}]"
        f" WHEN {lo(R.NUMBERS_SLASH)} AND greatest({num(1)}, {num(2)}) >= 100 THEN [{g(R.NUMBERS_SLASH, 1)}, {g(R.NUMBERS_SLASH, 2)}]"
        f" WHEN token IN {_in(R.PROTECTED)} OR tl IS NULL THEN [token] ELSE [trim({g(R.FUSED, 1, 'tl')}), trim({g(R.FUSED, 2, 'tl')})] END"
    )
    rule = f"CASE WHEN {lo(R.ENERGY_WORD.lower())} THEN 'energy_word' WHEN {lo(R.ENERGY_PAIR)} THEN 'energy_pair' WHEN {lo(R.ENERGY_UNIT)} THEN 'energy_unit' WHEN {lo(R.NUMBERS_SLASH)} AND greatest({num(1)}, {num(2)}) >= 100 THEN 'numbers' WHEN token IN {_in(R.PROTECTED)} OR tl IS NULL THEN NULL ELSE 'fused' END"
    return tok(
        "SELECT image_id, tok_idx, i - 1 AS part, ps[i] AS token, rule, CASE WHEN len(ps) > 1 THEN CAST(trunc(l) AS BIGINT) ELSE x1 END x1, CASE WHEN len(ps) > 1 THEN CAST(trunc(r) AS BIGINT) ELSE x2 END x2, round(CASE WHEN len(ps) > 1 THEN (l + r) / 2 ELSE cx END, 4) cx FROM s3",
        f"s0 AS (SELECT *, regexp_replace(token, {q(R.NRV_TAIL)}, '', 'g') un FROM tok)",
        f"s1 AS (SELECT *, {tail} tl FROM s0)",
        f"s2 AS (SELECT *, {parts} ps, {rule} rule FROM s1)",
        "sx AS (SELECT *, greatest(list_sum(list_transform(ps, lambda p: length(p))), 1)::DOUBLE al, coalesce(list_sum(list_transform(ps[1:i-1], lambda p: length(p))), 0) bf FROM s2, unnest(range(1, len(ps) + 1)) u(i))",
        "sy AS (SELECT *, x1 + (x2 - x1) * bf / al l FROM sx)",
        "s3 AS (SELECT *, l + (x2 - x1) * length(ps[i]) / al r FROM sy)",
    )


def split_in_two() -> str:
    number, unit = "regexp_extract(token, '^([0-9.,<>]+)', 1)", "trim(regexp_replace(token, '^[0-9.,<>]+', ''))"
    return tok(
        "SELECT image_id, tok_idx, h.half, h.token, h.x1, h.x2 FROM (SELECT image_id, tok_idx, unnest(hs) h FROM s1)",
        f"s0 AS (SELECT *, regexp_matches(lower(token), '^[0-9].*[a-zµ%]$') AND len(string_split(token, ' ')) <= 2 AND {unit} <> '' f, {number} nb, {unit} un, CAST(trunc(x1 + (x2 - x1) * 0.6) AS BIGINT) cut FROM tok)",
        "s1 AS (SELECT *, CASE WHEN f THEN [{'half': 0::BIGINT, 'token': nb, 'x1': x1, 'x2': cut}, {'half': 1::BIGINT, 'token': un, 'x1': cut, 'x2': x2}] ELSE [{'half': 0::BIGINT, 'token': token, 'x1': x1, 'x2': x2}] END hs FROM s0)",
    )


def merge_micro() -> str:
    near = lambda a, b: f"({b}x1 - {a}x2 <= 30 AND abs({a}cy - {b}cy) <= 15)"
    pair = lambda a, b: f"coalesce(regexp_matches({a}token, 'µ$') AND {b}token = 'g' AND {near(a, b)}, false)"
    triple = lambda a, b, c: f"coalesce(regexp_matches({a}token, '^[0-9.,]+$') AND {b}token = 'µ' AND {pair(b, c)} AND {near(a, b)}, false)"
    cols = ", ".join(f"{f}({c}, {k}) OVER w {n}_{c}" for n, f, k in (("n1", "lead", 1), ("n2", "lead", 2), ("p1", "lag", 1)) for c in ("token", "x1", "x2", "cy"))
    return tok(
        "SELECT image_id, tok_idx, CASE WHEN three THEN token || 'µg' WHEN two THEN token || 'g' ELSE token END AS token, x1, CASE WHEN three THEN n2_x2 WHEN two THEN n1_x2 ELSE x2 END x2, (two OR three) merged FROM m2 WHERE NOT gone",
        "m0 AS (SELECT image_id, tok_idx, CASE WHEN wn = 2 AND ln % 2 = 0 THEN 'µ' WHEN wn = 3 AND ln % 4 = 0 THEN 'g' ELSE token END AS token, x1 - 40 * wn x1, x2 - 40 * wn x2, cy FROM tok)",
        f"m1 AS (SELECT *, {cols} FROM m0 WINDOW w AS (PARTITION BY image_id ORDER BY tok_idx))",
        f"m2 AS (SELECT *, {triple('', 'n1_', 'n2_')} three, {pair('', 'n1_')} two, {pair('p1_', '')} OR {triple('p1_', '', 'n1_')} gone FROM m1)",
    )


def edit_snap() -> str:
    return tok(
        "SELECT word, m.term AS term, m.distance AS distance FROM (SELECT word, min({'distance': distance, 'term': term}) m FROM d WHERE distance <= 2 GROUP BY word)",
        f"lex(term) AS (VALUES {', '.join(f'({q(n)})' for n in R.NUTRIENTS)})",
        "words AS (SELECT DISTINCT lower(token) word FROM tok WHERE length(lower(token)) >= 5)",
        "d AS (SELECT word, term, dist AS distance FROM (SELECT word, term, " + _lev("word", "term") + " dist FROM words JOIN lex ON abs(length(word) - length(term)) <= 2))",
    )


def _lev(a: str, b: str) -> str:
    # Edit distance by characters: DuckDB's own counts bytes, so letters beyond ASCII become single bytes first.
    plain = lambda c: f"translate({c}, 'äöüßµéèêàâçñíóúáëïîôûùœ•–', '\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d')"
    return f"levenshtein({plain(a)}, {plain(b)})"


def across_lines() -> str:
    return tok(
        "SELECT image_id, tok_idx, hd.tok_idx AS head_idx FROM h1 WHERE cy - hd.cy > 0 AND cy - hd.cy <= 60 AND abs(cx - hd.cx) <= 140 AND NOT regexp_matches(token, '^[0-9<]')",
        "h1 AS (SELECT *, last_value(CASE WHEN lower(token) IN ('energie', 'fett', 'zucker') THEN {'tok_idx': tok_idx, 'cx': cx, 'cy': cy} END IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY tok_idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) hd FROM tok)",
    )


def header_units() -> str:
    p = r"^(.*[A-Za-zäöüß])\s*\((mg|g|µg|kJ|kcal|ml)\)$"
    return tok(
        "SELECT image_id, tok_idx, i - 1 AS piece, ps[i] AS token FROM h1, unnest(range(1, len(ps) + 1)) u(i)",
        "h0 AS (SELECT image_id, tok_idx, CASE WHEN wn = 0 AND ln % 2 = 0 THEN token || ' (g)' ELSE token END AS token FROM tok)",
        f"h1 AS (SELECT image_id, tok_idx, CASE WHEN regexp_matches(token, {q(p)}) THEN [regexp_extract(token, {q(p)}, 1), regexp_extract(token, {q(p)}, 2)] ELSE [token] END ps FROM h0)",
    )


def canonical(sql: str) -> str:
    return tok(
        sql,
        f"nm(name, canonical) AS (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in R.CANONICAL)})",
        f"n0 AS (SELECT image_id, tok_idx, {R.duck_normal('token')} nn FROM tok)",
        "n1 AS (SELECT *, trim(string_split_regex(nn, '[/|]')[1]) ns FROM n0)",
        "cn AS (SELECT image_id, tok_idx, nn norm_name, coalesce(a.canonical, b.canonical, CASE WHEN regexp_matches(nn, '^vitamin\\s+[a-z][0-9]*') THEN 'vitamin ' || regexp_extract(nn, '^vitamin\\s+([a-z][0-9]*)', 1) END) canonical FROM n1 LEFT JOIN nm a ON a.name = nn LEFT JOIN nm b ON b.name = ns)",
    )


def flags() -> str:
    parts = " UNION ALL ".join(f"SELECT image_id, {q(n)} flag FROM tok WHERE regexp_matches(token, {q(p)})" for p, n in R.SUSPICIOUS)
    return tok(f"SELECT flag, count(*) n_tokens, count(DISTINCT image_id) n_images FROM ({parts}) GROUP BY flag")


#: Tokens with the misreadings that the text corrector knows.
MISREAD = "CASE WHEN wn = 5 AND ln < 11 THEN CASE (image_id + ln) % 24 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(["Hagnesium", "4O5", "O25", "1O3", "4l7", "25 m0", "30M9", "12m", "kj", "KCAI", "Ug", "'Zink'", "|Salz|}", "40µ", "Saiz|Sait", "fettsauren", "Vltamln C", "5 Kj/12 KCal", "mg |", "Ph0sph0r", "Eiwelss"])) + " ELSE token END ELSE token END"


def first_level() -> str:
    fixed = R.duck_fold("trim(token)", R.FIRST_LEVEL)
    return tok(f"SELECT * FROM (SELECT token, trim(regexp_replace({fixed}, '\\s+', ' ', 'g')) corrected, n FROM (SELECT token, count(*) n FROM tok GROUP BY 1)) WHERE corrected <> token", token=MISREAD)


# Classification


def _lab() -> list[str]:
    context = R.duck_context("nn", "token")
    long = "(" + "|".join(n for n in L.NAMES if len(n) > 4) + ")"
    one = f"p IN {_in(L.NAMES)} OR regexp_matches(p, {q(long)}) OR starts_with(p, 'vitamin') OR regexp_matches(p, {q(R.VITAMIN)})"
    bare = "trim(regexp_replace(nn, '^[-–•]\\s*', ''))"
    short = lambda c: f"trim(trim(regexp_replace({c}, {q(R.UNIT_TAIL)}, '', 'g'), '.,!?;:- '))"
    parts = f"list_concat(string_split_regex({bare}, '\\s*/\\s*'), string_split_regex({short(bare)}, '\\s*/\\s*'))"
    nutrient = f"len(list_filter(list_concat({parts}, list_transform({parts}, lambda y: {short('y')})), lambda p: p <> '' AND ({one}))) > 0"
    noise = " OR ".join(f"contains(nn, {q(s)})" for s in L.NOISE)
    label = (
        f"CASE WHEN conf < 0.30 THEN 'NOISE' WHEN nn IN {_in(R.SINGLE_UNITS)} THEN 'UNIT' WHEN regexp_matches(nn, {q(R.NRV)}) THEN 'NOISE' WHEN ctx IS NOT NULL THEN 'CONTEXT' WHEN regexp_matches(nn, {q(R.SERVING)}) THEN 'NOISE'"
        f" WHEN (length(nn) <= 1 AND NOT regexp_matches(nn, '^[0-9]$')) OR {noise} THEN 'NOISE' WHEN un IN {_in(L.UNITS)} THEN 'UNIT' WHEN regexp_matches(trim(nn, '*''\"()[]. '), {q(R.QUANTITY)}) THEN 'QUANTITY' WHEN {nutrient} THEN 'NUTRIENT' ELSE 'UNKNOWN' END"
    )
    return [
        f"l0 AS (SELECT *, {R.duck_normal('token')} nn FROM tok)",
        f"l1 AS (SELECT *, {context} ctx, trim(nn, '.,*()[] ') un FROM l0)",
        f"l2 AS (SELECT *, {label} AS label, CASE WHEN conf < 0.30 OR nn IN {_in(R.SINGLE_UNITS)} THEN NULL WHEN regexp_matches(nn, {q(R.NRV)}) THEN 'NRV' WHEN ctx IS NULL AND regexp_matches(nn, {q(R.SERVING)}) THEN 'SERVING' END reference FROM l1)",
        "lab AS (SELECT *, CASE label WHEN 'CONTEXT' THEN ctx WHEN 'UNIT' THEN un ELSE nn END norm FROM l2)",
    ]


def lab(sql: str) -> str:
    return tok(sql, *_lab())


def early_labels() -> str:
    """The order of the earlier classifier, from the parts of the later one's."""
    parts = _lab()
    case = parts[2][parts[2].index("CASE WHEN conf") : parts[2].index(" AS label, CASE")]
    grab = lambda name: case.split(f" THEN '{name}'")
    quantity = grab("QUANTITY")[0].rsplit("WHEN ", 1)[1]
    nutrient = grab("NUTRIENT")[0].split("THEN 'QUANTITY' WHEN ", 1)[1]
    noise = " OR ".join(f"contains(nn, {q(s)})" for s in L.NOISE)
    early = f"CASE WHEN conf < 0.30 OR (length(nn) <= 1 AND NOT regexp_matches(nn, '^[0-9]$')) OR {noise} OR regexp_matches(nn, {q(R.NRV)}) OR regexp_matches(nn, {q(R.SERVING)}) THEN 'NOISE' WHEN un IN {_in(L.UNITS)} THEN 'UNIT' WHEN ctx IS NOT NULL THEN 'CONTEXT' WHEN {quantity} THEN 'QUANTITY' WHEN {nutrient} THEN 'NUTRIENT' ELSE 'UNKNOWN' END"
    return tok("SELECT image_id, tok_idx, label FROM l3", *parts[:2], f"l3 AS (SELECT image_id, tok_idx, {early} AS label FROM l1)")


def image_diagnostics() -> str:
    return tuples().rsplit("\nSELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY nutrient, rank, q) AS ord", 1)[0] + """,
tp AS (SELECT image_id, count(*) assoc_tuples, count(*) FILTER (quantity IS NULL) assoc_no_qty, count(*) FILTER (unit IS NULL) assoc_no_unit, count(*) FILTER (context IS NULL) assoc_no_ctx FROM tp3 WHERE k = 1 GROUP BY 1),
lb AS (SELECT image_id, count(*) ocr_total, count(*) FILTER (conf < 0.30) ocr_low_conf, count(*) FILTER (label = 'NUTRIENT') clf_nutrient, count(*) FILTER (label = 'QUANTITY') clf_quantity, count(*) FILTER (label = 'UNIT') clf_unit, count(*) FILTER (label = 'CONTEXT') clf_context, count(*) FILTER (label = 'NOISE') clf_noise, count(*) FILTER (label = 'UNKNOWN') clf_unknown FROM lab GROUP BY 1),
eg AS (SELECT image_id, count(*) FILTER (type = 'ROW_COMPAT') // 2 graph_same_row, count(*) FILTER (type = 'COL_COMPAT') // 2 graph_same_col, count(*) FILTER (type = 'DIRECTIONAL_ADJ') // 2 graph_adjacent, count(*) FILTER (type = 'CONTEXT_SCOPE') graph_ctx_scope FROM edg GROUP BY 1),
gd AS (SELECT image_id, count(*) gt_tuples FROM tok WHERE wn = 0 AND ln % 2 = 0 GROUP BY 1),
jn AS (SELECT image_id, COLUMNS(* EXCLUDE (image_id)) FROM lb LEFT JOIN eg USING (image_id) LEFT JOIN tp USING (image_id) LEFT JOIN gd USING (image_id)),
al AS (SELECT image_id, coalesce(COLUMNS(* EXCLUDE (image_id)), 0) FROM jn)
SELECT *, ocr_total - ocr_low_conf ocr_passed, round(100 * clf_noise / greatest(ocr_total, 1), 1) clf_noise_pct, graph_same_row + graph_same_col + graph_adjacent + graph_ctx_scope graph_total_edges, greatest(0, gt_tuples - clf_nutrient) lost_at_ocr, clf_unknown lost_at_clf, CASE WHEN clf_context > 0 THEN greatest(0, gt_tuples - graph_ctx_scope) ELSE 0 END lost_at_graph, assoc_no_qty lost_at_assoc FROM al"""


def prototypes(sql: str) -> str:
    return f"""WITH f AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) k FROM (SELECT DISTINCT vec_id, label FROM embeddings)) WHERE k <= 3),
p AS (SELECT 'c' || label category, embedding::DOUBLE[] v FROM embeddings WHERE vec_id IN (SELECT vec_id FROM f)),
e AS (SELECT vec_id, embedding::DOUBLE[] u FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM f)),
sc AS (SELECT vec_id, category, max(list_cosine_similarity(u, v)) score FROM e, p GROUP BY vec_id, category)
{sql}"""


_SER = "ser AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY image_id ORDER BY ln, x1, tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s FROM tok)"


def serialized(sql: str, *more: str) -> str:
    return tok(sql, _SER, *more)


def spans() -> str:
    return serialized(
        "SELECT image_id, tok_idx, b.entity AS entity, b.score AS score FROM (SELECT t.image_id, t.tok_idx, arg_max({'entity': 'e' || (x.tok_idx % 4), 'score': ((x.tok_idx * 7) % 10) / 10.0::DOUBLE}, ((x.tok_idx * 7) % 10) * 1000 - x.tok_idx) b FROM ser t JOIN ser x ON t.image_id = x.image_id AND x.s <= t.s AND t.s + length(t.token) <= x.s + length(x.token) + x.tok_idx % 3 * 8 GROUP BY t.image_id, t.tok_idx)"
    )


def entities() -> str:
    return """SELECT conv_id * 1000 + turn id, 0::BIGINT entity_idx, regexp_extract(text, '^([A-Za-z]*)', 1) AS text, CASE WHEN turn % 3 = 0 THEN 'NUTRIENT' ELSE 'UNIT' END kind
FROM conversations WHERE turn % 3 <> 2 AND regexp_extract(text, '^([A-Za-z]*)', 1) <> ''"""


# Enrichment


def compatible() -> str:
    c = lambda d: f"CASE WHEN abs({d}) <= 25 THEN round(1 - abs({d}) / 25.0, 4) ELSE 0.0 END"
    return tok(
        "SELECT image_id, count(*) FILTER (abs(dy) <= 25) rows_ok, count(*) FILTER (abs(dx) <= 25) cols_ok, sum(round(" + c("dy") + " * 10000)::BIGINT)::BIGINT row_conf, sum(round(" + c("dx") + " * 10000)::BIGINT)::BIGINT col_conf FROM p GROUP BY image_id",
        "p AS (SELECT a.image_id, b.cx - a.cx dx, b.cy - a.cy dy FROM tok a JOIN tok b ON a.image_id = b.image_id AND a.tok_idx < b.tok_idx)",
    )


def deskew() -> str:
    return tok(
        "SELECT image_id, count(*) n, round(list_sort(list(s))[len(list(s)) // 2 + 1], 6) slope FROM p GROUP BY image_id",
        "p AS (SELECT a.image_id, (b.cy - a.cy) / (b.cx - a.cx) s FROM tok a JOIN tok b ON a.image_id = b.image_id AND a.tok_idx < b.tok_idx AND abs(a.cx - b.cx) BETWEEN 1 AND 200 AND abs(a.cy - b.cy) <= 10)",
    )


def _grouped() -> list[str]:
    return [
        *_lab(),
        "g0 AS (SELECT *, greatest(max(y2) OVER (PARTITION BY image_id) / 500.0::DOUBLE, 1.0::DOUBLE) AS scale FROM lab WHERE label <> 'NOISE')",
        "g1 AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY image_id ORDER BY cy, tok_idx) > 25.0 * scale THEN 1 ELSE 0 END nr, CASE WHEN cx - lag(cx) OVER (PARTITION BY image_id ORDER BY cx, tok_idx) > 60.0 * scale THEN 1 ELSE 0 END nc FROM g0)",
        "grp AS (SELECT *, (sum(nr) OVER (PARTITION BY image_id ORDER BY cy, tok_idx ROWS UNBOUNDED PRECEDING))::BIGINT row_id, (sum(nc) OVER (PARTITION BY image_id ORDER BY cx, tok_idx ROWS UNBOUNDED PRECEDING))::BIGINT column_id FROM g1)",
        "h0 AS (SELECT *, label = 'CONTEXT' AND row_id <= 2 is_header FROM grp)",
        "hdr AS (SELECT *, arg_max(norm, tok_idx) FILTER (is_header) OVER (PARTITION BY image_id, column_id) column_context_id FROM h0)",
        "rc AS (SELECT image_id, column_id, label, count(*) c, min({'cy': cy, 'tok_idx': tok_idx}) f FROM grp GROUP BY ALL)",
        "r0 AS (SELECT image_id, column_id, sum(c)::BIGINT n, min({'k': -c, 'f': f, 'label': label}) m FROM rc GROUP BY ALL)",
        "r1 AS (SELECT image_id, column_id, n, CASE WHEN n < 2 OR -m.k / n < 0.4 THEN 'MIXED' WHEN m.label = 'NUTRIENT' THEN 'NUTRIENT' WHEN m.label IN ('QUANTITY', 'CONTEXT') THEN 'DOSAGE' WHEN m.label = 'UNIT' THEN 'UNIT' ELSE 'MIXED' END AS role FROM r0)",
        "rol AS (SELECT *, CASE WHEN role = 'DOSAGE' THEN (sum((role = 'DOSAGE')::INT) OVER (PARTITION BY image_id ORDER BY column_id ROWS UNBOUNDED PRECEDING))::BIGINT - 1 ELSE -1 END stream FROM r1)",
        "rnk AS (SELECT *, row_number() OVER (PARTITION BY image_id, row_id ORDER BY cx, tok_idx) - 1 rank_in_row"
        + "".join(f", CASE WHEN {c} THEN (sum(({c})::INT) OVER k)::BIGINT - 1 ELSE -1 END {n}" for n, c in (("data_rank_in_column", "NOT is_header"), ("qty_rank_in_column", "NOT is_header AND label = 'QUANTITY'"), ("nutrient_rank_in_column", "NOT is_header AND label = 'NUTRIENT'")))
        + " FROM hdr WINDOW k AS (PARTITION BY image_id, column_id ORDER BY cy, tok_idx ROWS UNBOUNDED PRECEDING))",
    ]


def grouped(sql: str, *more: str) -> str:
    return tok(sql, *_grouped(), *more)


def confidence(group: str, at: str, most: float) -> str:
    return grouped(
        f"SELECT image_id, {group}, coalesce(conf, 1.0)::DOUBLE conf FROM (SELECT DISTINCT image_id, {group} FROM grp) LEFT JOIN m USING (image_id, {group})",
        f"m AS (SELECT a.image_id, a.{group}, round(avg(greatest(0.0, 1 - abs(a.{at} - b.{at}) / ({most} * a.scale))), 4) conf FROM grp a JOIN grp b ON a.image_id = b.image_id AND a.{group} = b.{group} AND a.tok_idx < b.tok_idx GROUP BY 1, 2)",
    )


def diagnostics() -> str:
    return grouped(
        "SELECT image_id, n_tokens, n_noise, coalesce(n_rows, 0) n_rows, coalesce(n_columns, 0) n_columns, coalesce(n_headers, 0) n_headers, coalesce(n_streams, 0) n_streams, coalesce(rc, false) rank_consistent FROM t LEFT JOIN d USING (image_id)",
        "t AS (SELECT image_id, count(*) n_tokens, count(*) FILTER (label = 'NOISE') n_noise FROM lab GROUP BY 1)",
        "d AS (SELECT rnk.image_id, max(row_id) + 1 n_rows, max(rnk.column_id) + 1 n_columns, count(*) FILTER (is_header) n_headers, max(stream) + 1 n_streams, max(qty_rank_in_column) = max(nutrient_rank_in_column) rc FROM rnk JOIN rol USING (image_id, column_id) GROUP BY 1)",
    )


# Graph


def _edges(version: int) -> list[str]:
    row, col, adj = {1: ("SAME_ROW", "SAME_COL", "ADJACENT"), 2: ("ROW_COMPAT", "COL_COMPAT", "DIRECTIONAL_ADJ")}[version]
    w = (lambda d, t: f"round(1 - {d} / ({t} * sc), 4)") if version == 2 else (lambda d, t: "1.0::DOUBLE")
    side = lambda lo, hi: f"greatest(0, b.{lo} - a.{hi}, a.{lo} - b.{hi})::DOUBLE"
    target = "{y}.label = 'NUTRIENT'" if version == 1 else "{y}.label NOT IN ('CONTEXT', 'NOISE')"
    scope = lambda x, y: f"({x}.label = 'CONTEXT' AND {target.format(y=y)} AND {y}.cy - {x}.cy >= -25.0 * a.scale AND {y}.cy - {x}.cy <= 600.0 * a.scale)"
    head = lambda x, y: f"({x}.is_header AND NOT {y}.is_header AND a.column_id = b.column_id)"
    both = lambda kind, ok, weight: [f"SELECT image_id, {s} src, {d} dst, '{kind}' AS type, {weight} weight FROM pr WHERE {ok}" for s, d in (("i", "j"), ("j", "i"))]
    parts = both(row, "rw", w("dy", "25.0")) + both(col, "cl", w("dx", "20.0")) + both(adj, "NOT rw AND NOT cl AND gap <= 60.0 * sc", "round(1 - gap / (60.0 * sc), 4)")
    parts += ["SELECT image_id, i, j, 'CONTEXT_SCOPE', 1.0 FROM pr WHERE s1", "SELECT image_id, j, i, 'CONTEXT_SCOPE', 1.0 FROM pr WHERE s2"]
    if version == 2:
        parts += ["SELECT image_id, i, j, 'HEADER_SCOPE', 1.0 FROM pr WHERE h1", "SELECT image_id, j, i, 'HEADER_SCOPE', 1.0 FROM pr WHERE h2"]
    return [
        *_grouped(),
        "nod AS MATERIALIZED (SELECT rnk.*, rol.role, rol.stream FROM rnk JOIN rol USING (image_id, column_id))",
        f"pa AS (SELECT a.image_id, a.tok_idx i, b.tok_idx j, a.scale sc, abs(a.cy - b.cy) dy, abs(a.cx - b.cx) dx, {side('x1', 'x2')} gx, {side('y1', 'y2')} gy, {scope('a', 'b')} s1, {scope('b', 'a')} s2, {head('a', 'b')} h1, {head('b', 'a')} h2 FROM nod a JOIN nod b ON a.image_id = b.image_id AND a.tok_idx < b.tok_idx)",
        "pr AS (SELECT *, dy <= 25.0 * sc rw, dx <= 20.0 * sc cl, sqrt(gx * gx + gy * gy) gap FROM pa)",
        "edg AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")",
    ]


def edges(version: int, sql: str, *more: str, token: str | None = None) -> str:
    return tok(sql, *_edges(version), *more, token=token)


# Association


def _quantity(t: str = "token") -> tuple[str, str]:
    b = f"trim({t}, '*''\"()[]. ')"
    low = f"lower({b})"
    cases = " ".join(f"WHEN regexp_matches({low}, {q(p)}) THEN replace(regexp_extract({low}, {q(p)}, 1), ',', '.')" for p in (R.QTY_UNIT, R.QTY_ENERGY, R.QTY_PAREN, R.QTY_PLAIN))
    unit = " ".join(f"WHEN regexp_matches({low}, {q(p)}) THEN regexp_extract({low}, {q(p)}, 2)" for p in (R.QTY_UNIT, R.QTY_ENERGY))
    return f"CASE {cases} ELSE {b} END", f"CASE {unit} END"


_NAME = "trim(regexp_replace(token, '\\s+', ' ', 'g'), '.,:;*|- ')"


def parse_quantity() -> str:
    v, u = _quantity()
    nrv = "regexp_extract(token, '([0-9]+([.,][0-9]+)?)\\s*%', 1)"
    return tok(f"SELECT image_id, tok_idx, {v} AS value, {u} AS unit, CASE WHEN {nrv} <> '' THEN replace({nrv}, ',', '.') END nrv, {_NAME} AS name FROM tok")


def _found(key: str = "abs(q.cy - n.cy)", row: str = "ROW_COMPAT") -> list[str]:
    return [
        f"f0 AS (SELECT n.image_id, n.tok_idx nutrient, q.tok_idx q, q.cx, row_number() OVER (PARTITION BY n.image_id, n.tok_idx ORDER BY {key}, q.tok_idx) k FROM edg e JOIN nod n ON n.image_id = e.image_id AND n.tok_idx = e.src AND n.label = 'NUTRIENT' JOIN nod q ON q.image_id = e.image_id AND q.tok_idx = e.dst AND q.label = 'QUANTITY' WHERE e.type = '{row}'{' AND q.conf >= 0.30' if 'conf' in key else ''})",
        "fnd AS (SELECT image_id, nutrient, q, row_number() OVER (PARTITION BY image_id, nutrient ORDER BY cx, q) AS rank FROM f0 WHERE k <= 3)",
    ]


def quantities(key: str) -> str:
    return edges(2, "SELECT image_id, nutrient, q, rank FROM fnd", *_found(key))


def _fall(col: str = "COL_COMPAT") -> list[str]:
    return [
        "nofnd AS (SELECT * FROM nod WHERE label = 'NUTRIENT' AND NOT EXISTS (SELECT 1 FROM fnd WHERE fnd.image_id = nod.image_id AND fnd.nutrient = nod.tok_idx))",
        f"fl0 AS (SELECT n.image_id, n.tok_idx nutrient, q.tok_idx q, abs(q.cy - n.cy) d, CASE WHEN abs(q.cy - n.cy) <= 2.5 * greatest(n.y2 - n.y1, 20) THEN 'tight' ELSE 'wide' END band FROM nofnd n JOIN edg e ON e.image_id = n.image_id AND e.src = n.tok_idx AND e.type = '{col}' JOIN nod q ON q.image_id = e.image_id AND q.tok_idx = e.dst AND q.label = 'QUANTITY' WHERE abs(q.cy - n.cy) <= 8.0 * greatest(n.y2 - n.y1, 20))",
        "fall AS (SELECT image_id, nutrient, q, k AS rank, band FROM (SELECT *, row_number() OVER (PARTITION BY image_id, nutrient ORDER BY band, d, q) k, min(band) OVER (PARTITION BY image_id, nutrient) b FROM fl0) WHERE k <= 3 AND band = b)",
    ]


def column_fallback() -> str:
    return edges(2, "SELECT * FROM fall", *_found(), *_fall())


def _ranks(left: str) -> str:
    return f"r AS (SELECT n.image_id, n.tok_idx nutrient, x.tok_idx q, row_number() OVER (PARTITION BY n.image_id, n.tok_idx ORDER BY x.stream, x.tok_idx) AS rank FROM {left} n JOIN nod x ON x.image_id = n.image_id AND x.label = 'QUANTITY' AND x.stream >= 0 AND x.qty_rank_in_column = n.nutrient_rank_in_column WHERE n.nutrient_rank_in_column >= 0)"


def rank_fallback() -> str:
    return edges(2, "SELECT image_id, nutrient, q, rank FROM r WHERE rank <= 3", *_found(), _fall()[0], _ranks("nofnd"))


def _units(row: str = "ROW_COMPAT", adjacent: str = "DIRECTIONAL_ADJ") -> list[str]:
    pick = lambda kind: f"(SELECT image_id, id, arg_min(norm, {{'p': p, 'd': d, 'o': o}}) u FROM u0 WHERE type = '{kind}' GROUP BY 1, 2)"
    return [
        "u1 AS (SELECT e.image_id, e.type, x.tok_idx id, o.norm, o.tok_idx o, (o.cx > x.cx AND abs(o.cy - x.cy) <= 0.8 * greatest(x.y2 - x.y1, 15)) rt, o.cx - x.cx dx, abs(o.cy - x.cy) dy FROM edg e JOIN nod x ON x.image_id = e.image_id AND x.tok_idx = e.src AND x.label = 'QUANTITY' JOIN nod o ON o.image_id = e.image_id AND o.tok_idx = e.dst AND o.label = 'UNIT')",
        "u0 AS (SELECT *, CASE WHEN rt THEN 0 ELSE 1 END p, CASE WHEN rt THEN dx ELSE dy END d FROM u1)",
        f"unt AS (SELECT n.image_id, n.tok_idx id, r.u row_unit, a.u adj_unit FROM nod n LEFT JOIN {pick(row)} r ON r.image_id = n.image_id AND r.id = n.tok_idx LEFT JOIN {pick(adjacent)} a ON a.image_id = n.image_id AND a.id = n.tok_idx WHERE n.label = 'QUANTITY')",
    ]


def units() -> str:
    return edges(2, "SELECT * FROM unt", *_units())


_CTX = "ctx AS (SELECT e.image_id, e.dst id, arg_min(o.norm, {'d': abs(o.cx - x.cx), 'o': o.tok_idx}) graph_context FROM edg e JOIN nod o ON o.image_id = e.image_id AND o.tok_idx = e.src AND o.label = 'CONTEXT' JOIN nod x ON x.image_id = e.image_id AND x.tok_idx = e.dst WHERE e.type = 'CONTEXT_SCOPE' GROUP BY 1, 2)"


def contexts() -> str:
    return edges(2, "SELECT * FROM ctx", _CTX)


def smallest_context() -> str:
    return edges(2, "SELECT e.image_id, e.dst id, arg_min(o.norm, {'d': (o.x2 - o.x1) * (o.y2 - o.y1), 'o': o.tok_idx}) context FROM edg e JOIN nod o ON o.image_id = e.image_id AND o.tok_idx = e.src AND o.label = 'CONTEXT' WHERE e.type = 'CONTEXT_SCOPE' GROUP BY 1, 2")


#: Token texts with units in names, percentages, servings, and images without dosage columns, for the steps that need them.
MARKED = (
    "CASE WHEN image_id % 5 = 0 AND wn IN (1, 3) AND ln % 3 > 0 THEN 'mg' WHEN wn = 0 AND ln % 4 = 1 THEN 'Natrium (mg)' WHEN wn = 5 AND ln = 11 THEN '3 Gummies'"
    " WHEN wn = 5 AND ln % 3 = 0 THEN concat(ln + 5, ',5 %') WHEN wn IN (1, 2) AND ln % 6 = 2 THEN 'Text' WHEN wn IN (2, 4) AND ln % 4 = 1 THEN 'Text' ELSE token END"
)


def tuples(version: int = 2, token: str | None = None) -> str:
    row, col, adjacent = {1: ("SAME_ROW", "SAME_COL", "ADJACENT"), 2: ("ROW_COMPAT", "COL_COMPAT", "DIRECTIONAL_ADJ")}[version]
    v, u = _quantity()
    units_in = _in(R.ENERGY_UNITS)
    nrv = "regexp_extract({t}, '([0-9]+([.,][0-9]+)?)\\s*%', 1)"
    percent = lambda t: f"CASE WHEN {nrv.format(t=t)} <> '' THEN replace({nrv.format(t=t)}, ',', '.') END"
    embedded = f"nullif(trim(regexp_extract(lower(n.token), {q(R.EMBEDDED_UNIT)}, 1)), '')"
    refs = "SELECT x.image_id, x.tok_idx, r.tok_idx r, {p} p FROM nod x JOIN lab r ON r.image_id = x.image_id AND r.reference = 'NRV' AND abs(r.cy - x.cy) <= 25.0 * x.scale".format(p=percent("r.token"))
    return edges(
        version,
        "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY nutrient, rank, q) AS ord, name AS nutrient, quantity, unit, context, nrv_percent, serving_size FROM tp3 WHERE k = 1",
        *_found(row=row),
        *_fall(col),
        *_units(row, adjacent),
        "ctx AS (SELECT e.image_id, e.dst id, arg_min(coalesce(o.norm, o.column_context_id, o.token), {'d': abs(o.cx - x.cx), 'o': o.tok_idx}) graph_context FROM edg e JOIN nod o ON o.image_id = e.image_id AND o.tok_idx = e.src AND o.label = 'CONTEXT' JOIN nod x ON x.image_id = e.image_id AND x.tok_idx = e.dst WHERE e.type IN ('CONTEXT_SCOPE', 'HEADER_SCOPE') GROUP BY 1, 2)",
        "md AS (SELECT image_id, max((label = 'QUANTITY' AND stream >= 0)::INT) = 1 streams FROM nod GROUP BY 1)",
        "nofall AS (SELECT * FROM nofnd n WHERE NOT EXISTS (SELECT 1 FROM fall WHERE fall.image_id = n.image_id AND fall.nutrient = n.tok_idx))",
        _ranks("nofall"),
        "prs0 AS (SELECT image_id, nutrient, q, rank FROM fnd UNION ALL SELECT image_id, nutrient, q, rank FROM fall UNION ALL SELECT image_id, nutrient, q, rank FROM r WHERE rank <= 3)",
        f"nam AS (SELECT n.image_id, n.tok_idx nutrient, {_NAME} AS name, n.column_context_id ncol, c.graph_context nctx, {embedded} emb, n.cy, greatest(n.y2 - n.y1, 20) h, regexp_matches(lower({_NAME}), {q(R.ENERGY_NAME)}) en FROM nod n LEFT JOIN ctx c ON c.image_id = n.image_id AND c.id = n.tok_idx WHERE n.label = 'NUTRIENT')",
        f"enq AS (SELECT image_id, id FROM u1 WHERE type IN ('{row}', '{adjacent}') AND lower(norm) IN {units_in} GROUP BY ALL)",
        f"qty AS (SELECT n.image_id, n.tok_idx q, n.cx, n.cy, {v} AS quantity, coalesce({u}, unt.row_unit, unt.adj_unit) AS unit, coalesce(c.graph_context, n.column_context_id) qctx, coalesce({u} IN {units_in}, false) OR enq.id IS NOT NULL energy, {percent('n.token')} own_nrv FROM nod n LEFT JOIN unt ON unt.image_id = n.image_id AND unt.id = n.tok_idx LEFT JOIN ctx c ON c.image_id = n.image_id AND c.id = n.tok_idx LEFT JOIN enq ON enq.image_id = n.image_id AND enq.id = n.tok_idx WHERE n.label = 'QUANTITY')",
        "p1 AS (SELECT p.*, nam.en, qty.energy e, max(qty.energy::INT) OVER (PARTITION BY p.image_id, p.nutrient) = 1 anye FROM prs0 p JOIN nam USING (image_id, nutrient) JOIN qty ON qty.image_id = p.image_id AND qty.q = p.q)",
        "br0 AS (SELECT nam.image_id, nam.nutrient, qty.q, qty.cx, row_number() OVER (PARTITION BY nam.image_id, nam.nutrient ORDER BY abs(qty.cy - nam.cy), qty.q) k FROM nam JOIN qty ON qty.image_id = nam.image_id AND qty.energy AND abs(qty.cy - nam.cy) <= 4.0 * nam.h WHERE nam.en AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.image_id = nam.image_id AND p1.nutrient = nam.nutrient AND p1.anye))",
        "br AS (SELECT image_id, nutrient, q, row_number() OVER (PARTITION BY image_id, nutrient ORDER BY cx, q) AS rank FROM br0 WHERE k <= 6)",
        "prs AS (SELECT image_id, nutrient, q, rank FROM p1 WHERE NOT en OR e OR (NOT anye AND NOT EXISTS (SELECT 1 FROM br WHERE br.image_id = p1.image_id AND br.nutrient = p1.nutrient)) UNION ALL SELECT * FROM br)",
        f"nu1 AS (SELECT p.image_id, p.nutrient, p.q, o.norm, o.tok_idx o, (o.cx > x.cx AND abs(o.cy - x.cy) <= 0.8 * greatest(x.y2 - x.y1, 15)) rt, o.cx - x.cx dx, abs(o.cy - x.cy) dy FROM prs p JOIN nod x ON x.image_id = p.image_id AND x.tok_idx = p.q JOIN edg e ON e.image_id = p.image_id AND e.src = p.nutrient AND e.type = '{row}' JOIN nod o ON o.image_id = e.image_id AND o.tok_idx = e.dst AND o.label = 'UNIT')",
        "nun AS (SELECT image_id, nutrient, q, arg_min(norm, {'p': CASE WHEN rt THEN 0 ELSE 1 END, 'd': CASE WHEN rt THEN dx ELSE dy END, 'o': o}) u FROM nu1 GROUP BY 1, 2, 3)",
        f"pct AS (SELECT image_id, tok_idx, arg_min(p, r) p FROM ({refs}) WHERE p IS NOT NULL GROUP BY 1, 2)",
        "srv AS (SELECT image_id, arg_min(token, tok_idx) serving_size FROM lab WHERE reference = 'SERVING' GROUP BY 1)",
        "tp1 AS (SELECT nam.image_id, nam.nutrient, nam.name, prs.q, prs.rank, qty.quantity, CASE WHEN prs.q IS NOT NULL THEN coalesce(qty.unit, nun.u, nam.emb) END AS unit, CASE WHEN prs.q IS NOT NULL THEN coalesce(qty.qctx, nam.nctx, nam.ncol) WHEN md.streams THEN coalesce(nam.ncol, nam.nctx) ELSE coalesce(nam.nctx, nam.ncol) END AS context, CASE WHEN prs.q IS NOT NULL THEN coalesce(qty.own_nrv, a.p, b.p) END nrv_percent, srv.serving_size FROM nam JOIN md USING (image_id) LEFT JOIN prs USING (image_id, nutrient) LEFT JOIN qty ON qty.image_id = nam.image_id AND qty.q = prs.q LEFT JOIN nun ON nun.image_id = nam.image_id AND nun.nutrient = nam.nutrient AND nun.q = prs.q LEFT JOIN pct a ON a.image_id = nam.image_id AND a.tok_idx = prs.q LEFT JOIN pct b ON b.image_id = nam.image_id AND b.tok_idx = nam.nutrient LEFT JOIN srv ON srv.image_id = nam.image_id)",
        "tp3 AS (SELECT *, row_number() OVER (PARTITION BY image_id, name, quantity ORDER BY nutrient, rank, q) k FROM tp1)",
        token=token,
    )


def match_scores() -> str:
    s = "round(0.5 * (1 - least(1.0, abs(x.cy - n.cy) / (25.0 * n.scale))) + 0.4 * (1 / (1 + abs(n.nutrient_rank_in_column - x.qty_rank_in_column)::DOUBLE)) + 0.1 * (n.role = 'NUTRIENT' AND x.role = 'DOSAGE')::INT, 4)"
    return edges(2, f"SELECT image_id, count(*) n, sum(round(s * 10000)::BIGINT)::BIGINT score FROM (SELECT n.image_id, {s} s FROM edg e JOIN nod n ON n.image_id = e.image_id AND n.tok_idx = e.src AND n.label = 'NUTRIENT' JOIN nod x ON x.image_id = e.image_id AND x.tok_idx = e.dst AND x.label = 'QUANTITY' WHERE e.type = 'ROW_COMPAT') GROUP BY 1")


# Text


_PART = "pt AS (SELECT p_partkey image_id, p_name || ' pro 100 g contains ' || p_size || ' mg Zink und Calcium ' || p_size || ',5 mg provides 7 g Fett' AS text FROM part)"
_SENT = "snt AS (SELECT DISTINCT image_id, nutrient, quantity, unit FROM (SELECT image_id, 'Zink' nutrient, p_size::VARCHAR quantity, 'mg' unit FROM (SELECT p_partkey image_id, p_size FROM part) UNION ALL SELECT p_partkey, 'Fett', '7', 'g' FROM part))"


def sentences() -> str:
    return f"WITH {_SENT} SELECT * FROM snt"


def gate() -> str:
    amounts = "len(regexp_extract_all(token, '[0-9]+([.,][0-9]+)?\\s*(mg|µg|g|kj|kcal)'))"
    return f"""WITH {_PART}, t AS (SELECT image_id, unnest([text, text || ' 1 g 2 g 3 mg 4 g', text]) AS token FROM pt),
s AS (SELECT image_id, count(*) FILTER (length(token) > 60) l, sum({amounts}) a FROM t GROUP BY 1)
SELECT image_id FROM s WHERE l >= 2 AND a >= 8"""


#: A statement of each kind for every part.
STATEMENTS = (
    "CASE p_partkey % 7 WHEN 0 THEN concat('Jede Tablette enthält ', p_size, ',5 µg Colecalciferol, entsprechend ', p_size * 40, ' I.E. Vitamin') WHEN 1 THEN concat('Magnesium aus ', p_name, ', entsprechend ', p_size, ',25 mg. Zink, entsprechend ', p_size, ' UG')"
    " WHEN 2 THEN concat('Die Tagesdosis bis zu ', p_size, ' I.E. Vitamin D3 nicht') WHEN 3 THEN concat('Vitamin B12  ', p_size, ' mcg und VITAMIN B12 ', p_size, ' µg, Zink ', p_size, 'mg') WHEN 4 THEN concat(p_name, ' enthalt ', p_size, ' mg Zink enthält ', p_size, ' mg zink') WHEN 5 THEN p_name"
    " ELSE concat('tagesdosis ', p_size, ' g ', p_name, ' ', p_name, ' ', p_name, ' Eisen') END"
)


def sentence_families() -> str:
    from .operators.extract import FAMILIES, KNOWN

    names = "[" + ", ".join(q(n) for n in KNOWN) + "]"
    title = lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '[a-zäöüß]+|[^a-zäöüß]+'), lambda w: upper(w[1]) || w[2:]), '')"
    out = []
    for kind, (p, nutrient, quantity, unit) in FAMILIES.items():
        if nutrient:
            hits = f"SELECT image_id, unnest(regexp_extract_all(t, {q(p)})) s FROM st"
            name = f"trim(regexp_extract(s, {q(p)}, {nutrient}))"
            out.append(f"SELECT image_id, {name if kind != 'known' else title(f'lower({name})')} nutrient, regexp_extract(s, {q(p)}, {quantity}) quantity, regexp_extract(s, {q(p)}, {unit}) un FROM ({hits})")
        else:
            pieces = f"SELECT image_id, t, i, ms[i] s, array_to_string(list_transform(range(1, i), lambda j: ps[j] || ms[j]), '') || ps[i] bf FROM (SELECT image_id, t, regexp_extract_all(t, {q(p)}) ms, string_split_regex(t, {q(p)}) ps FROM st), unnest(range(1, len(ms) + 1)) u(i)"
            near = "lower(right(bf, 80))" if kind == "equal" else "lower(right(bf, 80) || s || substr(t, length(bf) + length(s) + 1, 80))"
            out.append(f"SELECT image_id, {title('nm')}, regexp_extract(s, {q(p)}, {quantity}), regexp_extract(s, {q(p)}, {unit}) FROM (SELECT image_id, s, list_filter({names}, lambda n: contains(nr, n))[1] nm FROM (SELECT *, {near} nr FROM ({pieces}))) WHERE nm IS NOT NULL")
    unit = "CASE WHEN lower(replace(un, '.', '')) IN ('ie', 'iu') THEN 'IE' WHEN lower(replace(un, '.', '')) IN ('µg', 'ug', 'mcg') THEN 'µg' ELSE trim(un) END"
    return f"""WITH st AS (SELECT p_partkey image_id, {STATEMENTS} t FROM part),
al AS ({' UNION ALL '.join(f'SELECT {i} k, * FROM ({x})' for i, x in enumerate(out))}),
nu AS (SELECT image_id, k, nutrient, replace(quantity, ',', '.') quantity, {unit} AS unit FROM al)
SELECT image_id, lower(nutrient) AS key, quantity, unit, min({{'k': k, 'n': nutrient}}).n AS nutrient, 'per_daily_dose' AS context FROM nu GROUP BY 1, 2, 3, 4"""


def replace_if_more() -> str:
    return "SELECT p_partkey image_id, greatest(2, 1 + p_size % 4)::BIGINT n, CASE WHEN 1 + p_size % 4 >= 2 THEN 'x' ELSE 'Zink' END nutrient FROM part"


# A reply by part: a full array (also with a trailing comma or in a fence), a cut-off one, or no JSON.
_ITEMS = "concat('{\"nutrient\":\"', p_name, ' (g)\",\"quantity\":\"', cast(p_size as string), ' ,5\",\"unit\":\"', CASE WHEN p_size % 2 = 0 THEN '' ELSE 'UG' END, '\",\"context\":\"', CASE WHEN p_size % 5 = 0 THEN 'per 10 g' ELSE 'je 100 g' END, '\"},{\"nutrient\":\"', p_brand, '\",\"quantity\":\"7\",\"unit\":\"mg\",\"context\":\"je 100 g\"},{\"nutrient\":\"', upper(p_brand), '\",\"quantity\":\"7\",\"unit\":\"MG\",\"context\":\"JE 100 G\"}')"
REPLY = f"CASE p_partkey % 5 WHEN 0 THEN concat('```json\n[', {_ITEMS}, ',]\n```') WHEN 1 THEN concat('<think>hm [x]</think>[', {_ITEMS}, ']') WHEN 2 THEN concat('[', {_ITEMS}, ',{{\"nutrient\":\"cut') WHEN 3 THEN 'sorry' ELSE concat('[', {_ITEMS}, ']') END".replace("{{", "{")


def replies(sql: str) -> str:
    return f"""WITH it0 AS (SELECT p_partkey image_id, CASE p_partkey % 5 WHEN 2 THEN 'salvaged' WHEN 3 THEN 'fail' ELSE 'full' END mode, unnest(CASE WHEN p_partkey % 5 = 3 THEN [0] ELSE [0, 1, 2] END) idx, p_name, p_brand, p_size FROM part),
it AS (SELECT *, CASE idx WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE upper(p_brand) END nutrient FROM it0),
c AS (SELECT image_id, idx::BIGINT idx, nutrient, CASE idx WHEN 0 THEN p_size || '.5' ELSE '7' END quantity, CASE WHEN idx > 0 THEN 'mg' WHEN p_size % 2 = 0 THEN 'g' ELSE 'µg' END AS unit, 'per_100g' AS context, row_number() OVER (PARTITION BY image_id, lower(nutrient), CASE idx WHEN 0 THEN p_size || '.5' ELSE '7' END ORDER BY idx) k FROM it WHERE mode <> 'fail'),
post AS (SELECT * FROM c WHERE k = 1)
{sql}"""


# Evaluation. Gold and predicted tuples from order lines; predictions differ by the keys.
_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) k FROM {table}) l"
_NAMES = "CASE l_partkey % 7 WHEN 0 THEN 'Fett / fat' WHEN 1 THEN 'Eiweiß' WHEN 2 THEN 'Salz' WHEN 3 THEN 'Zucker' WHEN 4 THEN 'Vitamin C' WHEN 5 THEN 'Calcium' ELSE 'Kohlenhydrate' END"
_PNAMES = "CASE WHEN l_partkey % 11 = 0 THEN 'Unbekannt' ELSE CASE l_partkey % 7 WHEN 0 THEN 'fat' WHEN 1 THEN 'Eiweiss' WHEN 2 THEN 'SALZ' WHEN 3 THEN 'Zucker' WHEN 4 THEN 'Vitamin-C' WHEN 5 THEN 'Calcium' ELSE 'Kohlenhydrat' END END"
_UNIT = "CASE l_linenumber % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'mg' WHEN 2 THEN 'IE' ELSE 'kcal' END"
_PUNIT = "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CASE l_linenumber % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'mg' WHEN 2 THEN 'iu' ELSE 'cal' END END"
_CONTEXT = "CASE l_suppkey % 3 WHEN 0 THEN 'per 100g' WHEN 1 THEN 'per serving (30 g)' ELSE NULL END"
_PCONTEXT = "CASE WHEN l_partkey % 17 = 0 THEN 'per 100ml' ELSE CASE l_suppkey % 3 WHEN 0 THEN 'Per 100g' WHEN 1 THEN 'per serving' ELSE NULL END END"
GOLD = f"SELECT l_orderkey AS image_id, CAST(k AS BIGINT) AS g, {_NAMES} AS nutrient, CAST(CAST(l_quantity AS INT) AS STRING) AS quantity, {_UNIT} AS unit, {_CONTEXT} AS context FROM {_LINES}"
PRED = f"SELECT l_orderkey AS image_id, CAST(k AS BIGINT) AS p, {_PNAMES} AS nutrient, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE concat(CAST(CAST(l_quantity AS INT) + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS STRING), ',0') END AS quantity, {_PUNIT} AS unit, {_PCONTEXT} AS context FROM {_LINES}"


def _nq(c: str) -> str:
    t = f"replace(trim(lower({c})), ',', '.')"
    n = f"CASE WHEN regexp_matches({t}, '^[+-]?[0-9]+(\\.[0-9]*)?$') THEN TRY_CAST({t} AS DOUBLE) END"
    return n, t


def _nu(c: str) -> str:
    t = f"replace(trim(lower({c})), 'μ', 'µ')"
    return f"CASE {t} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in R.UNIT_ALIASES.items()) + f" ELSE {t} END"


def evaluation(sql: str, matched: bool = True) -> str:
    gn, gt = _nq("g.quantity")
    pn, pt = _nq("p.quantity")
    ctx = lambda c: f"regexp_replace(trim(regexp_replace(lower({c}), '\\s*\\([^)]*\\)', '', 'g')), '\\s+', '_', 'g')"
    x, y = R.duck_fold_letters("trim(g.nutrient)"), R.duck_fold_letters("trim(p.nutrient)")
    seg = lambda c: f"list_filter(list_transform(string_split_regex({R.duck_fold_letters(c)}, '[/|]'), lambda s: trim(s)), lambda s: s <> '')"
    bare = lambda c: f"regexp_replace({c}, '[- ]', '', 'g')"
    fast = f"CASE WHEN {x} = {y} OR {bare(x)} = {bare(y)} OR ((contains({x}, {y}) OR contains({y}, {x})) AND least(length({x}), length({y})) / greatest(length({x}), length({y}), 1) >= 0.65) THEN true END"
    name = f"({x} = {y} OR {bare(x)} = {bare(y)} OR ((contains({x}, {y}) OR contains({y}, {x})) AND least(length({x}), length({y})) / greatest(length({x}), length({y}), 1) >= 0.65) OR list_has_any({seg('g.nutrient')}, {seg('p.nutrient')}))"
    same = lambda a, b, u, v: f"coalesce({a} = {b}, {u} IS NULL AND {v} IS NULL)"
    more = [
        f"gold AS ({GOLD.format(table='lineitem')})",
        f"pred AS ({PRED.format(table='lineitem')})",
        f"c0 AS (SELECT image_id, g.g, p.p, {fast} fn, {name} name_ok, coalesce(abs(({gn}) - ({pn})) < 1e-9, coalesce({gt}, '') = coalesce({pt}, '')) qty_ok, {same(_nu('g.unit'), _nu('p.unit'), 'g.unit', 'p.unit')} unit_ok, {same(ctx('g.context'), ctx('p.context'), 'g.context', 'p.context')} ctx_ok FROM gold g JOIN pred p USING (image_id))",
        "cand AS (SELECT * EXCLUDE (fn), 2.0::DOUBLE * name_ok::INT + qty_ok::INT + 0.5 * unit_ok::INT score FROM c0)",
    ]
    if matched:
        more += [
            "rk AS (SELECT image_id, g, p, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN qty_ok AND unit_ok AND ctx_ok THEN 100.0 ELSE score END DESC, g, p) k FROM cand WHERE name_ok AND (score >= 2.0 OR (qty_ok AND unit_ok AND ctx_ok)))",
            _GREEDY,
            "mat AS (SELECT cand.*, qty_ok AND unit_ok full_3f, qty_ok AND unit_ok AND ctx_ok full_4f FROM cand JOIN (SELECT rk.image_id, rk.g, rk.p FROM rk JOIN walk w ON w.image_id = rk.image_id AND w.k = rk.k WHERE w.took) USING (image_id, g, p))",
        ]
    return "WITH RECURSIVE " + ",\n".join(more) + "\n" + sql


# Walks the ranked pairs of all images at once, one rank a step.
_GREEDY = """walk AS (
 SELECT image_id, 1::BIGINT k, [g] gs, [p] ps, true took FROM rk WHERE k = 1
 UNION ALL
 SELECT rk.image_id, rk.k, CASE WHEN f.free THEN list_append(w.gs, rk.g) ELSE w.gs END, CASE WHEN f.free THEN list_append(w.ps, rk.p) ELSE w.ps END, f.free
 FROM walk w JOIN rk ON rk.image_id = w.image_id AND rk.k = w.k + 1, LATERAL (SELECT NOT list_contains(w.gs, rk.g) AND NOT list_contains(w.ps, rk.p) free) f)"""


def first_fit() -> str:
    more = [
        f"gold AS ({GOLD.format(table='lineitem')})",
        f"pred AS ({PRED.format(table='lineitem')})",
        "rk AS (SELECT image_id, g.g, p.p, row_number() OVER (PARTITION BY image_id ORDER BY g.g, p.p) k FROM gold g JOIN pred p USING (image_id) WHERE contains(lower(g.nutrient), lower(p.nutrient)) OR contains(lower(p.nutrient), lower(g.nutrient)))",
        _GREEDY,
    ]
    return "WITH RECURSIVE " + ",\n".join(more) + "\nSELECT rk.image_id, rk.g, rk.p FROM rk JOIN walk w ON w.image_id = rk.image_id AND w.k = rk.k WHERE w.took"


_PCT = ", ".join(f"round_even(100.0 * count(*) FILTER ({c}) / greatest(count(mat.g), 1), 0)::BIGINT {n}" for c, n in (("qty_ok", "qty_pct"), ("unit_ok", "unit_pct"), ("ctx_ok", "ctx_pct"), ("full_3f", "full3f_pct"), ("full_4f", "full4f_pct")))
PER_IMAGE = f"SELECT image_id, any_value(gt) gt, any_value(pd) AS pred, count(mat.g) AS match, {_PCT} FROM (SELECT image_id, count(*) gt FROM gold GROUP BY 1) JOIN (SELECT image_id, count(*) pd FROM pred GROUP BY 1) USING (image_id) LEFT JOIN mat USING (image_id) GROUP BY image_id"
_F1 = lambda c: f"round(CASE WHEN {c} > 0 THEN 2 * ({c} / n_pred) * ({c} / n_gold) / ({c} / n_pred + {c} / n_gold) ELSE 0 END, 6)"
METRICS = (
    f"SELECT *, round(100 * (f1_3f - f1_4f), 4) context_cost_pp FROM (SELECT *, round(tp / n_pred, 6) AS precision, round(tp / n_gold, 6) AS recall, {_F1('tp')} f1, {_F1('full3')} f1_3f, {_F1('full4')} f1_4f, round(qty / tp, 6) qty_acc, round(unit / tp, 6) unit_acc, round(ctx / tp, 6) ctx_acc FROM"
    " (SELECT (SELECT count(*) FROM gold) n_gold, (SELECT count(*) FROM pred) n_pred, count(*) tp, count(*) FILTER (qty_ok) qty, count(*) FILTER (unit_ok) AS unit, count(*) FILTER (ctx_ok) ctx, count(*) FILTER (full_3f) full3, count(*) FILTER (full_4f) full4 FROM mat))"
)

# Boxes in groups of 50 with integer places, so that overlaps are exact.
BOXES = ["p_partkey div 50 AS image_id", "p_partkey AS tok_idx", "cast((p_partkey * 7919) % 1000 as bigint) / cast(1000 as double) AS conf", "cast((p_partkey * 37) % 60 as bigint) AS x1", "cast((p_partkey * 53) % 40 as bigint) AS y1", "cast((p_partkey * 37) % 60 + 20 + p_size % 10 as bigint) AS x2", "cast((p_partkey * 53) % 40 + 15 + p_size % 7 as bigint) AS y2"]


def suppress() -> str:
    return f"""WITH RECURSIVE b AS (SELECT {', '.join(x.replace(' div ', ' // ') for x in BOXES)} FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, tok_idx) k FROM b),
v AS (SELECT x.image_id, x.k i, y.k j, greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1)) w, (x.x2 - x.x1) * (x.y2 - x.y1) + (y.x2 - y.x1) * (y.y2 - y.y1) s FROM o x JOIN o y ON x.image_id = y.image_id AND x.k < y.k),
n AS (SELECT o.image_id, o.k, o.tok_idx, coalesce(list(v.i) FILTER (v.w > 0.5 * (v.s - v.w)), []) over_ FROM o LEFT JOIN v ON v.image_id = o.image_id AND v.j = o.k GROUP BY ALL),
walk AS (SELECT image_id, k, [k] kept, true took FROM n WHERE k = 1 UNION ALL
 SELECT n.image_id, n.k, CASE WHEN list_has_any(w.kept, n.over_) THEN w.kept ELSE list_append(w.kept, n.k) END, NOT list_has_any(w.kept, n.over_) FROM walk w JOIN n ON n.image_id = w.image_id AND n.k = w.k + 1)
SELECT image_id, tok_idx FROM walk JOIN n USING (image_id, k) WHERE took"""


# Names


RAW_NAMES = [
    "Energie", " ENERGIE kJ ", "Brennwert ...... Energie", "- davon Zucker", "• Fett:", "FETT:", "fett", "Eiweiß / Protein / Proteine", "Salz | Salt", "Zout/ Sel", "kohlenhydrate/carbohydrate",
    "Vitamin E**", "magnesium*", "Koffein (aus Guarana)", "Vitamin A (RE)", "vitamin a (aus Provitamin A) / vitamin a", "davon  gesättigte   Fettsäuren", "- Of which saturates | davon", "Folsäure", "B12", "C",
    "Vitamin(e) B6 / x", "  ", "Zinc/Zink", "CHOLIN", "B 6 (x)", "vitamin b 12", "Thiamin", "L-Isoleucine", "Matière grasse", "acides gras satures", "Natrium (Na)", "μ-Selen", "Creatine Monohydrate", "Kreatin", "alpha liponic",
]


def raw_names() -> str:
    """A name for each part, most of them from a list, some with the part's own words."""
    n = len(RAW_NAMES)
    cases = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(RAW_NAMES))
    return f"CASE WHEN p_partkey % {n + 4} < {n} THEN CASE p_partkey % {n + 4} {cases} END WHEN p_partkey % {n + 4} = {n} THEN NULL WHEN p_partkey % {n + 4} = {n + 1} THEN concat(p_name, ' / Fett') WHEN p_partkey % {n + 4} = {n + 2} THEN concat('Fett / ', p_name) ELSE concat(p_name, ' (', p_brand, ')') END"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def gold_names(sql: str) -> str:
    from .functions import name_tables as N
    from .operators.names import SEPARATORS

    dash = "'^[-–—•]\\s*'"
    cleaned = _strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_strip('nm')}, {dash}, ''), ':+$', ''), '\\s*\\.{{2,}}\\s*', ' / ', 'g'), '\\s+', ' ', 'g')")
    keys = [("exact", "exact", _strip("nm")), ("cleaned", "exact", "cl")]
    for x in SEPARATORS:
        first = f"CASE WHEN contains(cl, {q(x)}) THEN {_strip(f'split_part(cl, {q(x)}, 1)')} END"
        keys += [("segment", "exact", first), ("segment", "lower", f"lower({first})"), ("segment", "lower", _strip(f"regexp_replace(lower({first}), {dash}, '')"))]
    bare = _strip("regexp_replace(cl, '\\*+$', '')")
    keys += [("lower", "lower", "lower(cl)"), ("starred", "exact", bare), ("starred", "lower", f"lower({bare})")]
    table = ", ".join(f"({q(t)}, {q(k)}, {q(v)})" for t, rows in (("exact", N.EXACT), ("lower", N.SEGMENTS)) for k, v in rows)
    asked = " UNION ALL ".join(f"SELECT nm, {i} n_at, {q(stage)} stage, {q(t)} tb, {key} k FROM cn" for i, (stage, t, key) in enumerate(keys))
    pattern = "CASE WHEN regexp_matches(lower(cl), '^koffein\\b') THEN 'Caffeine' WHEN regexp_matches(lower(cl), '^vitamin\\s*a\\s*\\(') THEN 'Vitamin A' END"
    return f"""WITH rw AS (SELECT p_partkey, {raw_names()} nm FROM part),
cn AS (SELECT DISTINCT nm, {cleaned} cl FROM rw WHERE nm IS NOT NULL),
tb(tb, k, v) AS (VALUES {table}),
hit AS (SELECT nm, min({{'n_at': n_at, 'stage': stage, 'v': v}}) b FROM ({asked}) JOIN tb USING (tb, k) GROUP BY nm),
res AS (SELECT rw.p_partkey, rw.nm, coalesce(hit.b.v, {pattern}, cl) canonical, CASE WHEN rw.nm IS NOT NULL THEN coalesce(hit.b.stage, CASE WHEN {pattern} IS NOT NULL THEN 'pattern' END, 'text') END stage FROM rw LEFT JOIN cn ON cn.nm = rw.nm LEFT JOIN hit ON hit.nm = rw.nm)
{sql}"""


def model_names() -> str:
    from .functions import name_tables as N

    def ascii_(c: str) -> str:
        c = f"lower({c})"
        for a, b in N.ASCII:
            c = f"replace({c}, {q(a)}, {q(b)})"
        return c

    raw = f"trim(regexp_replace(replace(replace(replace({_strip(chr(99) + 'oalesce(nm, ' + chr(39) * 2 + ')')}, 'μ', 'µ'), '–', '-'), '—', '-'), '\\s+', ' ', 'g'), ' .,:;|/\\-_*')"
    rule = "CASE WHEN raw = '' THEN 0 " + " ".join(f"WHEN regexp_matches({on}, {q(p)}) THEN {i}" for i, (on, p, _) in enumerate(N.CASCADE, 1)) + " ELSE 0 END"
    value = []
    for i, (on, p, v) in enumerate(N.CASCADE, 1):
        text = q(v)
        if "\\" in v:
            text = q(v.split("\\")[0]) + f" || upper(regexp_extract({on}, {q(p)}, 1))" + (f" || regexp_extract({on}, {q(p)}, 2)" if v.count("\\") > 1 else "")
        value.append(f"WHEN {i} THEN {text}")
    bare = _strip("regexp_replace(raw, '\\([^)]*\\)', '', 'g')")
    return f"""WITH rw AS (SELECT p_partkey, {raw_names()} nm FROM part), a AS (SELECT *, {raw} raw FROM rw), b0 AS (SELECT *, {bare} br FROM a),
c AS (SELECT *, {ascii_('raw')} w, {_strip(ascii_('br'))} b FROM b0), d AS (SELECT *, {rule} rule FROM c)
SELECT p_partkey, rule, CASE rule {' '.join(value)} ELSE CASE WHEN br <> '' THEN br ELSE raw END END canonical FROM d"""


# Labels from two sources

#: Rows of tokens by line, and a vector for most texts: the embedding whose number the text's letters give.
VECTOR_OF = "(length(context) * 31 + ascii(context) * 7) % 601"


def _hybrid(mode: str) -> list[str]:
    from .functions import name_tables as N
    from .operators.hybrid import CATEGORIES

    names = ", ".join(f"max(s) FILTER (category = {q(c)}) {c.lower()}_s" for c in CATEGORIES)
    rest = ", ".join(f"{{'score': coalesce({c.lower()}_s, 0), 'o': {-i}, 'category': {q(c)}}}" for i, c in enumerate(CATEGORIES[1:]))
    labels = "('UNKNOWN')" if mode == "hybrid" else "('UNKNOWN', 'NUTRIENT')"
    fold = lambda c: f"replace(translate(lower({c}), 'äöüéèáàíúý', 'aoueeaaiuy'), 'ß', 'ss')"
    words = lambda c: f"list_filter(list_transform(string_split_regex({c}, '[^a-zA-Z0-9äöüßÄÖÜéèáàíúýÉÈ]+'), lambda z: {fold('z')}), lambda z: length(z) >= 2 AND z NOT IN {_in(N.STOPWORDS)})"
    part = lambda w: f"(list_contains(words, {w}) OR len(list_filter(words, lambda g: length({w}) >= 3 AND length(g) >= 3 AND (contains(g, {w}) OR contains({w}, g)) AND least(length({w}), length(g)) / greatest(length({w}), length(g)) >= 0.6)) > 0)"
    return [
        *_lab(),
        "ct0 AS (SELECT image_id, tok_idx, label, token, count(*) OVER (PARTITION BY image_id, ln) n, list(token) OVER (PARTITION BY image_id, ln ORDER BY cx, tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) al, list(token) OVER (PARTITION BY image_id, ln ORDER BY cx, tok_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) nr FROM lab)",
        "ct AS (SELECT image_id, tok_idx, label, token, array_to_string(CASE WHEN n > 10 THEN nr ELSE al END, ' ') context FROM ct0)",
        "pf AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) k FROM (SELECT DISTINCT vec_id, label FROM embeddings)) WHERE k <= 3)",
        f"pp AS (SELECT [{', '.join(q(c) for c in CATEGORIES)}][label % 5 + 1] category, embedding::DOUBLE[] v FROM embeddings WHERE vec_id IN (SELECT vec_id FROM pf))",
        f"tx AS (SELECT context, any_value(embedding)::DOUBLE[] u FROM (SELECT DISTINCT context FROM ct WHERE label IN {labels}) JOIN embeddings ON vec_id = {VECTOR_OF} GROUP BY context)",
        "cs AS (SELECT context, category, max(list_cosine_similarity(u, v)) s FROM tx, pp GROUP BY ALL)",
        f"wd AS (SELECT context, {names} FROM cs GROUP BY context)",
        f"wo AS (SELECT *, list_sort([{rest}])[-1] o FROM wd)",
        f"hy AS (SELECT ct.image_id, ct.tok_idx, ct.token, ct.context, ct.label rule_label, CASE WHEN ct.label IN {labels} THEN 'embedding' ELSE 'rule' END AS method, wo.* EXCLUDE (context), CASE WHEN ct.label NOT IN {labels} THEN ct.label WHEN coalesce(nutrient_s >= 0.2 AND nutrient_s - o.score >= 0.04, false) THEN 'NUTRIENT' ELSE 'UNKNOWN' END AS label FROM ct LEFT JOIN wo ON wo.context = ct.context AND ct.label IN {labels})",
        f"gw AS (SELECT image_id, list_distinct(flatten(list({words('gn')}))) words FROM (SELECT image_id, token || ' gesamt' gn FROM tok WHERE wn IN (0, 5) AND ln % 2 = 0) GROUP BY image_id)",
        f"dm0 AS (SELECT hy.*, coalesce(words, []) words, {fold('trim(token)')} ft FROM hy LEFT JOIN gw USING (image_id) WHERE method = 'embedding' AND nutrient_s IS NOT NULL)",
        f"dm AS (SELECT image_id, tok_idx, token, context, rule_label, {', '.join(f'round(coalesce({c.lower()}_s, 0), 4) + 0.0 {c.lower()}_score' for c in CATEGORIES)}, round(o.score, 4) + 0.0 second_best_score, o.category second_best_cat, round(nutrient_s - o.score, 4) + 0.0 margin_actual, (length(ft) >= 2 AND {part('ft')})::INT gt_label, (label = 'NUTRIENT')::INT current_pred, (len(list_filter({words('token')}, lambda w: {part('w')})) > 0)::INT parts FROM dm0)",
    ]


def hybrid(sql: str, mode: str = "hybrid") -> str:
    return tok(sql, *_hybrid(mode))


# Walks along an image's tokens, one place of all images a step


def row_contexts() -> str:
    return tok(
        "SELECT image_id, tok_idx, rw AS row FROM walk",
        "o AS (SELECT image_id, tok_idx, cy, row_number() OVER (PARTITION BY image_id ORDER BY cy, tok_idx) k FROM tok)",
        """walk AS (SELECT image_id, k, tok_idx, 0::BIGINT rw, cy mean, 1::BIGINT n FROM o WHERE k = 1 UNION ALL
 SELECT o.image_id, o.k, o.tok_idx, CASE WHEN abs(o.cy - w.mean) > 15 THEN w.rw + 1 ELSE w.rw END, CASE WHEN abs(o.cy - w.mean) > 15 THEN o.cy ELSE w.mean + (o.cy - w.mean) / (w.n + 1) END, CASE WHEN abs(o.cy - w.mean) > 15 THEN 1 ELSE w.n + 1 END FROM walk w JOIN o ON o.image_id = w.image_id AND o.k = w.k + 1)""",
    )


def lines() -> str:
    return tok(
        "SELECT o.image_id, o.tok_idx, list_position(ord, own[o.k]) - 1 line_id FROM o JOIN (SELECT image_id, own, list_transform(list_sort(list_transform(range(1, len(ms) + 1), lambda i: {'m': ms[i], 'i': i})), lambda z: z.i) ord FROM (SELECT image_id, arg_max(ms, k) ms, arg_max(own, k) own FROM walk GROUP BY image_id)) USING (image_id)",
        "th AS (SELECT *, greatest(8.0, 0.5 * quantile_cont((y2 - y1)::DOUBLE, 0.5) OVER (PARTITION BY image_id ORDER BY cy, tok_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))::DOUBLE t FROM tok)",
        "o AS (SELECT image_id, tok_idx, cy, t, row_number() OVER (PARTITION BY image_id ORDER BY cy, tok_idx) k FROM th)",
        """walk AS (SELECT image_id, k, [cy] ms, [1::BIGINT] cs, [1::BIGINT] own FROM o WHERE k = 1 UNION ALL
 SELECT image_id, k, CASE WHEN near.d <= t THEN list_transform(range(1, len(ms) + 1), lambda i: CASE WHEN i = near.i THEN ms[i] + (cy - ms[i]) / (cs[i] + 1) ELSE ms[i] END) ELSE list_append(ms, cy) END, CASE WHEN near.d <= t THEN list_transform(range(1, len(ms) + 1), lambda i: CASE WHEN i = near.i THEN cs[i] + 1 ELSE cs[i] END) ELSE list_append(cs, 1) END, list_append(own, CASE WHEN near.d <= t THEN near.i ELSE len(ms) + 1 END)
 FROM (SELECT o.image_id, o.k, o.cy, o.t, w.ms, w.cs, w.own, list_sort(list_transform(range(1, len(w.ms) + 1), lambda i: {'d': abs(o.cy - w.ms[i]), 'i': i}))[1] near FROM walk w JOIN o ON o.image_id = w.image_id AND o.k = w.k + 1))""",
    )


def merge_compounds(prefixes: tuple[str, ...], gap: float) -> str:
    return tok(
        "SELECT image_id, hd tok_idx, string_agg(token, ' ' ORDER BY tok_idx) AS token, arg_min(x1, tok_idx) x1, max(x2) x2, min(y1) y1, max(y2) y2, count(*) - 1 n_merged FROM walk JOIN tok USING (image_id, tok_idx) GROUP BY 1, 2",
        "o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tok_idx) k FROM tok)",
        f"""walk AS (SELECT image_id, k, tok_idx, tok_idx hd, cy hcy, x2 hx, 0 n, lower(token) IN {_in(prefixes)} op FROM o WHERE k = 1 UNION ALL
 SELECT o.image_id, o.k, o.tok_idx, CASE WHEN f.nr THEN w.hd ELSE o.tok_idx END, CASE WHEN f.nr THEN w.hcy ELSE o.cy END, CASE WHEN f.nr THEN greatest(w.hx, o.x2) ELSE o.x2 END, CASE WHEN f.nr THEN w.n + 1 ELSE 0 END, CASE WHEN f.nr THEN true ELSE lower(o.token) IN {_in(prefixes)} END
 FROM walk w JOIN o ON o.image_id = w.image_id AND o.k = w.k + 1, LATERAL (SELECT w.op AND w.n < 4 AND abs(o.cy - w.hcy) <= 20 AND o.x1 - w.hx <= {gap} AND NOT regexp_matches(o.token, '^[0-9]') nr) f)""",
    )


# Regions

BLOCKS = "blk AS (SELECT *, max(x2) OVER (PARTITION BY image_id) AS width, max(y2) OVER (PARTITION BY image_id) AS height FROM tok), tb AS (SELECT *, floor(height * 0.4::DOUBLE)::BIGINT room FROM blk WHERE (x2 - x1) / greatest(y2 - y1, 1) > 2 AND (x2 - x1) / greatest(y2 - y1, 1) < 60 AND (x2 - x1) * (y2 - y1) > 200 AND (x2 - x1) * (y2 - y1) < width * height * 0.15::DOUBLE)"


def densest_window() -> str:
    return tok(
        "SELECT image_id, min(b.x1) x1, min(b.y1) y1, max(b.x2) x2, max(b.y2) y2, count(*) n FROM best JOIN tb b USING (image_id) WHERE best.n >= 4 AND b.y1 >= best.y AND b.y2 <= best.y + best.room GROUP BY image_id HAVING max(b.x2) - min(b.x1) > any_value(b.width) * 0.2::DOUBLE",
        BLOCKS,
        "win AS (SELECT a.image_id, a.y1 y, a.room, a.tok_idx, count(b.tok_idx) n FROM tb a LEFT JOIN tb b ON b.image_id = a.image_id AND b.y1 >= a.y1 AND b.y2 <= a.y1 + a.room GROUP BY ALL)",
        "best AS (SELECT image_id, arg_min(y, {'n': -n, 'y': y}) y, any_value(room) room, max(n) n FROM win GROUP BY image_id)",
    )


def oriented() -> str:
    """Tokens with corners: level, rising or falling ones by image, and their geometry."""
    return tok(
        "SELECT a.image_id, count(*) FILTER (same AND abs(across) <= 25) rows_ok, count(*) FILTER (same AND abs(along) <= 25) cols_ok, count(*) FILTER (same) same_way FROM (SELECT a.image_id, (b.cx - a.cx) * a.dx + (b.cy - a.cy) * a.dy along, (b.cx - a.cx) * -a.dy + (b.cy - a.cy) * a.dx across, degrees(acos(least(1.0, abs(a.dx * b.dx + a.dy * b.dy)))) <= 15 same FROM gm a JOIN gm b ON a.image_id = b.image_id AND a.tok_idx < b.tok_idx) a GROUP BY 1",
        f"qd AS (SELECT *, (x2 - x1)::DOUBLE ex, {SLANT}::DOUBLE ey FROM tok)",
        "gm AS (SELECT *, CASE WHEN sqrt(ex * ex + ey * ey) >= 1e-8 THEN ex / sqrt(ex * ex + ey * ey) ELSE 1.0 END dx, CASE WHEN sqrt(ex * ex + ey * ey) >= 1e-8 THEN ey / sqrt(ex * ex + ey * ey) ELSE 0.0 END dy FROM qd)",
    )


SLANT = "(CASE image_id % 3 WHEN 0 THEN 0 WHEN 1 THEN x2 - x1 ELSE (x1 - x2) * (tok_idx % 4) END)"


def oriented_angles() -> str:
    return tok(f"SELECT image_id, tok_idx, round(degrees(atan2(ey, ex)), 6) + 0.0 angle_deg FROM (SELECT image_id, tok_idx, CASE WHEN x2 = x1 AND {SLANT} = 0 THEN 1.0 ELSE (x2 - x1)::DOUBLE END ex, {SLANT}::DOUBLE ey FROM tok)")


def rank_alignment() -> str:
    v, _ = _quantity("f.token")
    return edges(
        2,
        "SELECT (SELECT count(*) FILTER (ok) FROM agr) rank_consistent, (SELECT count(*) FILTER (NOT ok) FROM agr) rank_inconsistent, count(*) with_rank, count(*) FILTER (has) matched, count(*) FILTER (NOT has) unmatched, count(*) FILTER (many) multi, count(*) FILTER (many AND right_) multi_correct, count(*) FILTER (many AND NOT right_) multi_wrong, (SELECT count(*) FROM nm a JOIN nm b ON a.image_id = b.image_id AND a.r < b.r AND a.fq < b.fq) in_order, (SELECT count(*) FROM nm a JOIN nm b ON a.image_id = b.image_id AND a.r < b.r AND a.fq > b.fq) out_of_order FROM nm",
        "col AS (SELECT image_id, column_id, any_value(role) AS role, count(*) FILTER (nutrient_rank_in_column >= 0) names, count(*) FILTER (qty_rank_in_column >= 0) qs, min(tok_idx) f FROM nod GROUP BY 1, 2)",
        "ig AS (SELECT image_id, arg_min(names, f) FILTER (role = 'NUTRIENT') n, list(qs) FILTER (role = 'DOSAGE') d FROM col GROUP BY 1)",
        "agr AS (SELECT len(list_filter(d, lambda x: x <> n)) = 0 ok FROM ig WHERE n IS NOT NULL AND d IS NOT NULL)",
        "gld AS (SELECT image_id, ln g, lower(max(token) FILTER (wn = 0)) name, replace(coalesce(max(token) FILTER (wn = 1), ''), ',', '.') val FROM tok GROUP BY 1, 2)",
        "rq AS (SELECT e.image_id, e.src id, o.tok_idx q, o.qty_rank_in_column qr, o.token FROM edg e JOIN nod o ON o.image_id = e.image_id AND o.tok_idx = e.dst AND o.label = 'QUANTITY' WHERE e.type = 'ROW_COMPAT')",
        "rn AS (SELECT n.image_id, n.tok_idx id, n.nutrient_rank_in_column r, lower(n.token) tx, count(rq.q) c, arg_min(rq.token, rq.q) FILTER (rq.qr = n.nutrient_rank_in_column) token, arg_min(rq.qr, rq.q) FILTER (rq.qr >= 0) fq FROM nod n LEFT JOIN rq ON rq.image_id = n.image_id AND rq.id = n.tok_idx WHERE n.label = 'NUTRIENT' AND n.nutrient_rank_in_column >= 0 GROUP BY ALL)",
        "gm AS (SELECT rn.image_id, rn.id, arg_min(val, g) val FROM rn JOIN gld ON gld.image_id = rn.image_id AND (contains(coalesce(name, ''), tx[:10]) OR contains(tx, coalesce(name, '')[:10])) GROUP BY 1, 2)",
        f"nm AS (SELECT f.*, c > 2 many, {v} = gm.val right_, EXISTS (SELECT 1 FROM nod q WHERE q.image_id = f.image_id AND q.label = 'QUANTITY' AND q.role = 'DOSAGE' AND q.qty_rank_in_column = f.r) has FROM rn f LEFT JOIN gm USING (image_id, id))",
    )


# Profiles


def sweep(sql: str, grid: str = "range(30, 76) a(t), range(0, 26) b(m)") -> str:
    p, r = "(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END)", "(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)"
    return f"""WITH s AS (SELECT n_chars % 101 score100, (doc_id * 7) % 60 margin100, quality gold FROM documents JOIN labels USING (doc_id)),
h AS (SELECT t, m, score100 >= t AND margin100 >= m hit, gold = 1 g FROM s, {grid}),
c AS (SELECT t, m, count(*) FILTER (hit AND g) tp, count(*) FILTER (hit AND NOT g) fp, count(*) FILTER (NOT hit AND g) fn, count(*) FILTER (NOT hit AND NOT g) tn FROM h GROUP BY t, m),
cells AS (SELECT *, round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6) f1 FROM c)
{sql}"""


def literal_fixes() -> str:
    t = f"trim(token, {q(R.BORDER)})"
    for old, new in R.LITERALS:
        t = f"replace({t}, {q(old)}, {q(new)})"
    return tok(f"SELECT token, count(*) n FROM (SELECT trim({t}) token FROM tok) WHERE token <> '' GROUP BY 1")


SCIENTIFIC = "concat(p_size, ',5 x 10^', p_size % 9, CASE p_size % 4 WHEN 0 THEN ' KBE' WHEN 1 THEN 'cfu' WHEN 2 THEN '' ELSE ' mg' END)"


def split_scientific() -> str:
    p = q("(?i)" + R.SCIENTIFIC)
    return f"""WITH t AS (SELECT p_partkey, {SCIENTIFIC} token, p_size::DOUBLE x1, p_size + 100.0::DOUBLE x2 FROM part),
u AS (SELECT *, trim(regexp_extract(token, {p}, 1)) v, trim(regexp_extract(token, {p}, 2)) w FROM t),
c AS (SELECT *, x1 + (x2 - x1) * length(v) / length(token) cut FROM u)
SELECT p_partkey, 0::BIGINT part, CASE WHEN w <> '' THEN v ELSE token END token, x1, round(CASE WHEN w <> '' THEN cut ELSE x2 END, 6) x2 FROM c
UNION ALL SELECT p_partkey, 1, w, round(cut, 6), x2 FROM c WHERE w <> ''"""


def image_scores() -> str:
    p, r = "(match / pd)", "(match / gt)"
    return f"(SELECT image_id, round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN match > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6) f1 FROM (SELECT image_id, gt, pred AS pd, match FROM ({PER_IMAGE})))"
