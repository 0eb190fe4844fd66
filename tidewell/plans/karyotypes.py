"""SQL of the whole karyotype block: clones, their inherited events, and all flags, parsed by DuckDB on its own."""

from __future__ import annotations

import tidewell.config as C
from tidewell.plans.fixtures import oracle


def _no_lookahead(pattern: str) -> str:
    """A pattern for an engine without lookahead: what must not follow is matched as something else or the end."""
    for chars in ("0-9", "a-z0-9", "a-zA-Z0-9"):
        pattern = pattern.replace(f"(?![{chars}])", f"(?:[^{chars}]|$)")
    return pattern


def _normalized(text: str) -> str:
    for pattern, by in C.NORMALIZATION:
        if pattern.endswith(r"(?=\()"):
            pattern, by = pattern.removesuffix(r"(?=\()") + r"\(", by + "("
        text = f"regexp_replace({text}, '(?i){pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return text


_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(e, '^(?:{p})') THEN '{n}'" for n, p in C.EVENTS.items()) + " END"
_HAS = ", ".join(f"CAST(regexp_matches(t, '(?i){_no_lookahead(p)}') AS INT) AS {n}" for n, p in C.SPECIFIC_ABNORMALITIES.items())
_RANGES = r"regexp_extract_all(t, '(\d{1,2})\s*[-~]\s*(\d{1,2})', #)"
_NUMBERS = "list_transform(" + _RANGES + ", lambda x: CAST(x AS DOUBLE))"
_COUNTED = ", ".join(f"coalesce({n}, 0) AS {n}" for n in C.EVENTS)

_CLONES = rf"""
  k AS (SELECT raw, t, regexp_matches(t, '^\s*\d{{1,2}}') AS listed, regexp_matches(t, '(?i)^normal$') AS normal, regexp_matches(t, '(?i){C.FREE_TEXT_COMPLEX}') AS many
    FROM (SELECT DISTINCT CYTOGENETICS AS raw, {_normalized(_STRIPPED.format('CYTOGENETICS'))} AS t FROM @ WHERE CYTOGENETICS IS NOT NULL)),
  listed AS (SELECT raw, list_filter(list_transform(string_split_regex(t, '\s*/\s*|\s{{2,}}'), lambda x: {_STRIPPED.format('x')}), lambda x: x <> '') AS cs FROM k WHERE listed),
  pieces AS (SELECT raw, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM listed),
  bodies AS (SELECT raw, pos, coalesce(TRY_CAST(nullif(regexp_extract(c, '\[\s*(?:cp)?\s*(\d+)(?:/\d+)?\s*\]$', 1), '') AS INT), 1) AS cells,
    {_STRIPPED.format(r"regexp_replace(c, '\[\s*(?:cp)?\s*(\d+)(?:/\d+)?\s*\]$', '')")} AS body FROM pieces),
  texts AS (SELECT raw, pos, cells, contains(lower(body), 'idem') AS inherits, regexp_replace(regexp_replace(body, '^\s*\d{{1,2}}(?:-\d{{1,2}})?\s*,\s*X[XY]*', ''), '^[, ]+|[, ]+$', '', 'g') AS events FROM bodies),
  sources AS (SELECT raw, pos, regexp_replace(events, '(?i)idem', '', 'g') AS events FROM texts UNION ALL SELECT raw, 0, t FROM k WHERE NOT listed AND NOT normal AND NOT many),
  parts AS (SELECT raw, pos, lower({_STRIPPED.format("unnest(string_split_regex(events, '[,;]'))")}) AS e FROM sources),
  kinds AS (SELECT raw, pos, {_KIND} AS kind FROM parts WHERE e <> ''),
  own AS (SELECT s.raw, s.pos, {', '.join(f"count(*) FILTER (kind = '{n}') AS {n}" for n in C.EVENTS)} FROM sources s LEFT JOIN kinds USING (raw, pos) GROUP BY ALL),
  runs AS (SELECT own.*, coalesce(cells, 1) AS cells, coalesce(inherits, false) AS inherits, sum(CASE WHEN coalesce(inherits, false) THEN 0 ELSE 1 END) OVER (PARTITION BY raw ORDER BY pos) AS run FROM own LEFT JOIN texts USING (raw, pos)),
  summed AS (SELECT raw, pos, cells, inherits, {', '.join(f"sum({n}) OVER (PARTITION BY raw, run ORDER BY pos) AS {n}" for n in C.EVENTS)} FROM runs),
  clones AS (SELECT *, {' + '.join(C.EVENTS)} AS abn FROM summed),
  most AS (SELECT raw, {', '.join(C.EVENTS)}, abn AS most_abn FROM clones QUALIFY row_number() OVER (PARTITION BY raw ORDER BY abn DESC, pos) = 1),
  main AS (SELECT raw, cells AS main_cells, abn AS main_abn FROM clones QUALIFY row_number() OVER (PARTITION BY raw ORDER BY cells DESC, pos) = 1),
  totals AS (SELECT raw, CAST(max(inherits) AS INT) AS idem, count(*) AS n, sum(cells) AS all_cells, sum(cells * abn) / sum(cells) AS mean_abn FROM clones GROUP BY raw),
  f AS (SELECT raw, t, {_COUNTED}, CASE WHEN listed THEN idem ELSE 0 END AS has_idem, CASE WHEN listed THEN coalesce(n, 0) ELSE 1 END AS clone_count, CASE WHEN listed THEN coalesce(all_cells, 0) ELSE 1 END AS total_cell_count,
    CASE WHEN listed THEN coalesce(main_cells, 0) ELSE 1 END AS main_clone_cell_count, CASE WHEN NOT listed AND NOT normal AND many THEN 3 ELSE coalesce(main_abn, 0) END AS main_clone_abnormality_count,
    CASE WHEN NOT listed AND NOT normal AND many THEN 3 ELSE coalesce(mean_abn, 0) END AS num_cyto_abnormalities
    FROM k LEFT JOIN most USING (raw) LEFT JOIN main USING (raw) LEFT JOIN totals USING (raw))"""

_FLAGS = rf"""
  g AS (SELECT *, {_HAS}, TRY_CAST(nullif(regexp_extract(t, '^\s*(\d+)', 1), '') AS DOUBLE) AS chromosome_count,
    list_min({_NUMBERS.replace('#', '1')}) AS chromosome_count_min, list_max({_NUMBERS.replace('#', '2')}) AS chromosome_count_max, len({_RANGES.replace('#', '1')}) AS ranges,
    CASE WHEN regexp_matches(t, '(?i)XY') THEN 1 WHEN regexp_matches(t, '(?i)XX') THEN 0 END AS sex_chromosomes, len(regexp_extract_all(t, '(?i)\+\s*[xy]')) AS sex_chromosome_gain_count,
    len(regexp_extract_all(t, '(?i)-\s*[xy]')) AS sex_chromosome_loss_count, {' + '.join(C.STRUCTURAL)} AS structural_count, n_plus + n_minus AS numerical_count,
    list_transform(regexp_extract_all(t, '\[cp(\d+)\]', 1), lambda x: CAST(x AS INT)) AS cps, len(list_filter(regexp_extract_all(t, '-(\d+)', 1), lambda x: regexp_matches(x, '^([1-9]|1\d|2[0-2])$'))) AS monosomies FROM f),
  h AS (SELECT * EXCLUDE (t, ranges, cps, monosomies), CAST(coalesce(chromosome_count < 46, false) AS INT) AS hypodiploidy, CAST(coalesce(chromosome_count >= 49, false) AS INT) AS hyperdiploidy,
    CAST(coalesce(chromosome_count BETWEEN 60 AND 80, false) AS INT) AS near_triploidy, chromosome_count_max - chromosome_count_min AS chromosome_range_span, CAST(ranges > 0 AS INT) AS chromosome_range_detected,
    CAST(coalesce(sex_chromosomes = 0, false) AS INT) AS SEX_XX, CAST(coalesce(sex_chromosomes = 1, false) AS INT) AS SEX_XY, CAST(sex_chromosomes IS NULL AS INT) AS SEX_UNKNOWN,
    CAST(sex_chromosome_gain_count + sex_chromosome_loss_count > 0 AS INT) AS sex_chromosome_abnormality_flag,
    CAST(regexp_matches(t, '(?i)^\s*46\s*,\s*X[XY]\s*(\[.+\])?$|\bnormal\b') AND num_cyto_abnormalities = 0 AS INT) AS normal_karyotype,
    del_5q_or_mono5 AS del_5q, monosomy_7_or_del7q AS monosomy_7, del_17p_or_i17q AS del_17p, CAST(num_cyto_abnormalities >= {C.COMPLEX_FROM} AS INT) AS complex_karyotype,
    CAST(n_der > 0 AS INT) AS has_derivative_chromosome, CAST(n_mar > 0 AS INT) AS has_marker_chromosome, CAST(n_ring > 0 AS INT) AS has_ring_chromosome, CAST(n_dmin > 0 AS INT) AS has_double_minutes,
    CAST(regexp_matches(t, '\binc\b|incomplete') AS INT) AS incomplete_karyotype, coalesce(list_max(cps), 0) AS cp_max, CAST(len(cps) > 0 AS INT) AS cp_any,
    CAST(monosomies >= 2 OR (monosomies = 1 AND structural_count > 0) AS INT) AS monosomal_karyotype, regexp_matches(t, '(?i){C.FAVORABLE_CYTO}') AS good FROM g),
  i AS (SELECT *, greatest(del_5q_or_mono5, monosomy_7_or_del7q, del_17p_or_i17q, rearr_3q26, monosomal_karyotype) AS any_adverse_cyto FROM h),
  j AS (SELECT * EXCLUDE (good), CAST(any_adverse_cyto = 1 OR complex_karyotype = 1 AS INT) AS eln_cyto_adverse, CAST(good AND any_adverse_cyto = 0 AND complex_karyotype = 0 AS INT) AS eln_cyto_favorable,
    CAST(NOT good AND any_adverse_cyto = 0 AND complex_karyotype = 0 AS INT) AS eln_cyto_intermediate FROM i)"""

def block(view: str) -> str:
    """Every column of the block, for the texts of one of the views."""
    return oracle(
        f"WITH {_CLONES},{_FLAGS} SELECT ID, round(COLUMNS(* EXCLUDE (ID))::DOUBLE, 6)"
        " FROM (SELECT ID, CAST(CYTOGENETICS IS NULL AS INT) AS cyto_is_missing, j.* EXCLUDE (raw) FROM @ LEFT JOIN j ON CYTOGENETICS = raw)".replace("@", view),
        view,
    ).replace("FROM @", f"FROM {view}")


#: A term's pattern for presence in a part, and the one whose occurrences version 2 counts (`p` is the part).
_TERMS = {
    "num_translocations": (r"t\(\d+;\d+\)", r"t\(\d+;\d+\)"),
    "num_deletions": (r"del\(", r"del\([^)]*\)"),
    "num_inversions": (r"inv\(", r"inv\([^)]*\)"),
    "num_duplications": (r"dup\(", r"dup\([^)]*\)"),
    "num_additions": (r"add\(", r"add\([^)]*\)"),
    "num_monosomies": (r"-\d+", r"-\d+"),
    "num_trisomies": (r"\+\d+", r"\+\d+"),
}


def _amount(present: str, counted: str, name: str) -> str:
    # version 2 leaves out a minus after a letter or a parenthesis
    part = r"regexp_replace(p, '([a-zA-Z(])-', '\1', 'g')" if name == "num_monosomies" else "p"
    return f"coalesce(sum((CASE WHEN version = 2 THEN len(regexp_extract_all({part}, '{counted}')) ELSE CAST(regexp_matches(p, '{present}') AS INT) END) * w), 0) AS {name}"


def summaries(view: str) -> str:
    """The four versions of the older summary, one row for each version and text."""
    terms = list(_TERMS)
    return oracle(
        rf"""WITH v AS (SELECT unnest([1, 2, 3, 4]) AS version),
        k AS (SELECT DISTINCT version, CYTOGENETICS AS raw, CASE WHEN version = 1 OR trim(CYTOGENETICS) <> '' THEN lower(CYTOGENETICS) END AS t FROM {view}, v WHERE CYTOGENETICS IS NOT NULL),
        c AS (SELECT version, raw, unnest(string_split(t, '/')) AS c, generate_subscripts(string_split(t, '/'), 1) AS pos FROM k),
        n AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(c, '\[(\d+)\]', 1), '') AS INT), CASE WHEN version = 1 THEN 0 ELSE 1 END) AS cells FROM c),
        w AS (SELECT *, CASE WHEN version = 1 THEN 1 ELSE cells END AS w, string_split(regexp_replace(c, '\[\d+\]', '', 'g'), ',') AS split FROM n),
        p AS (SELECT version, raw, w, pos, trim(unnest(split)) AS p, generate_subscripts(split, 1) AS nth FROM w),
        s AS (SELECT *, CASE WHEN contains(p, 'xy') THEN 1 WHEN contains(p, 'xx') THEN -1 END AS s, CASE WHEN regexp_matches(p, '^\d+$') THEN CAST(p AS DOUBLE) END AS x FROM p),
        a AS (SELECT version, raw, {', '.join(_amount(*_TERMS[n], n) for n in terms)}, CASE WHEN version = 1 THEN coalesce(arg_min(s, pos * 1000 + nth) FILTER (s IS NOT NULL), 0) ELSE coalesce(sign(sum(s * w)), 0) END AS sided,
          sum(x * w) / nullif(sum(w) FILTER (x IS NOT NULL), 0) AS avg_chromosomes FROM s GROUP BY version, raw),
        m AS (SELECT version, raw, count(*) AS num_subclones, sum(cells) AS total_mitoses, sum(w) AS mitoses FROM w GROUP BY version, raw),
        e AS (SELECT version, raw, -sum(CASE WHEN w > 0 THEN w / mitoses * ln(w / mitoses) ELSE 0 END) AS entropy FROM w JOIN m USING (version, raw) WHERE mitoses > 0 GROUP BY version, raw),
        o AS (SELECT ID, v.version, (coalesce(sided, 0) + 1) / 2 AS sex, avg_chromosomes, coalesce(total_mitoses, 0) AS total_mitoses, coalesce(num_subclones, 0) AS num_subclones, {', '.join(f'coalesce({n}, 0) AS {n}' for n in terms)},
          coalesce({' + '.join(terms[:5])}, 0) AS complexity_score, CASE WHEN v.version > 1 THEN CAST(coalesce(contains(t, 'complex'), false) AS INT) END AS complex_flag,
          CASE WHEN v.version > 2 THEN CASE WHEN mitoses > 0 AND num_subclones > 1 THEN entropy / ln(num_subclones) ELSE 0 END END AS mosaicism_index
          FROM {view} CROSS JOIN v LEFT JOIN k ON CYTOGENETICS = k.raw AND v.version = k.version LEFT JOIN a ON k.raw = a.raw AND k.version = a.version LEFT JOIN m ON k.raw = m.raw AND k.version = m.version
          LEFT JOIN e ON k.raw = e.raw AND k.version = e.version)
        SELECT ID, round(COLUMNS(* EXCLUDE (ID))::DOUBLE, 6) FROM o""",
        view,
    )
