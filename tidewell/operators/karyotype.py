"""Karyotype text as features, with native array functions only.

Semantics to keep: the normalisation drops cell counts after marker, ring and sex-chromosome terms, so such a clone counts one cell; a range
of chromosome numbers is one of the event classes; the first of equally abnormal (or equally large) clones counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.config import COMPLEX_FROM, EVENTS, FAVORABLE_CYTO, FREE_TEXT_COMPLEX, NORMALIZATION, SPECIFIC_ABNORMALITIES, STRUCTURAL
from tidewell.functions.nulls import flag
from tidewell.operators.ordered import settle

_NAMES = list(EVENTS)

# fixed values: how clones are parted, what a clone's cell count and its beginning look like
CLONE_BREAK = r"\s*/\s*|\s{2,}"
CELL_COUNT = r"\[\s*(?:cp)?\s*(\d+)(?:/\d+)?\s*\]$"
CLONE_START = r"^\s*\d{1,2}(?:-\d{1,2})?\s*,\s*X[XY]*"


def normalized(text: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, "(?i)" + r[0], r[1]), NORMALIZATION, text)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _strip_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"^[, ]+|[, ]+$", "")


def event_counts(text: Column) -> Column:
    """Counts of the event classes in one clone's text, in the order of the configuration. An event belongs to the first class that matches its start."""
    parts = F.filter(F.transform(F.split(text, "[,;]"), lambda e: F.lower(_strip(e))), lambda e: e != "")

    def kind(e: Column) -> Column:
        out = F.when(e.rlike(f"^(?:{EVENTS[_NAMES[0]]})"), 0)
        for i, n in enumerate(_NAMES[1:], 1):
            out = out.when(e.rlike(f"^(?:{EVENTS[n]})"), i)
        return out.otherwise(-1)

    found = F.transform(parts, kind)
    def of_kind(found: Column, i: int) -> Column:
        return F.size(F.filter(found, lambda x: x == i))

    return F.get(F.transform(F.array(found), lambda k: F.array(*[of_kind(k, i) for i in range(len(_NAMES))])), F.lit(0))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


def clones(df: DataFrame, text: str = "CYTOGENETICS") -> DataFrame:
    """Event counts of the first most abnormal clone, has_idem, clone_count, total_cell_count, main clone's cells and abnormalities, and the
    cell-weighted mean of abnormalities."""
    norm = normalized(_strip(F.col(text)))
    zero = F.array(*[F.lit(0)] * len(_NAMES))
    raw = F.filter(F.transform(F.split(F.col("_norm"), CLONE_BREAK), _strip), lambda c: c != "")

    def piece(c: Column) -> Column:
        body = _strip(F.regexp_replace(c, CELL_COUNT, ""))
        events = _strip_commas(F.regexp_replace(body, CLONE_START, ""))
        idem = F.lower(events).contains("idem")
        return F.struct(
            F.coalesce(F.regexp_extract(c, CELL_COUNT, 1).try_cast("int"), F.lit(1)).alias("cells"),
            F.lower(body).contains("idem").alias("inherits"),
            idem.alias("idem"),
            F.when(idem, _strip_commas(F.regexp_replace(events, "(?i)idem", ""))).otherwise(events).alias("events"),
        )

    df = df.withColumn("_norm", norm)
    df = df.withColumn("_pieces", F.transform(raw, piece))
    df = df.withColumn("_own", F.transform("_pieces", lambda p: F.struct(p["cells"].alias("cells"), p["inherits"].alias("inherits"), p["idem"].alias("idem"), event_counts(p["events"]).alias("counts"))))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    start = F.struct(zero.alias("last"), F.slice(F.array(F.struct(F.lit(0).alias("cells"), zero.alias("counts"))), 1, 0).alias("out"))

    def fold(acc: Column, c: Column) -> Column:
        now = F.when(c["inherits"], added(acc["last"], c["counts"])).otherwise(c["counts"])
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(F.struct(c["cells"].alias("cells"), now.alias("counts")))).alias("out"))

    df = df.withColumn("_clones", F.aggregate("_own", start, fold)["out"])
    df = df.withColumn("_clones", F.transform("_clones", lambda c: F.struct(c["cells"].alias("cells"), c["counts"].alias("counts"), _total(c["counts"]).alias("abn"))))
    listed = F.col("_norm").rlike(r"^\s*\d{1,2}")
    normal = F.col("_norm").rlike(r"(?i)^normal$")
    complex_text = ~listed & ~normal & F.col("_norm").rlike("(?i)" + FREE_TEXT_COMPLEX)
    free = ~listed & ~normal & ~complex_text
    df = df.withColumn("_free", F.when(free, event_counts(F.col("_norm"))))
    df = df.withColumns({"_most": F.array_max(F.transform("_clones", lambda c: c["abn"])), "_cells": F.array_max(F.transform("_clones", lambda c: c["cells"]))})
    any_clone = listed & (F.size("_clones") > 0)
    most = F.get(F.filter("_clones", lambda c: c["abn"] == F.col("_most")), F.lit(0))
    main = F.get(F.filter("_clones", lambda c: c["cells"] == F.col("_cells")), F.lit(0))
    cells = F.aggregate("_clones", F.lit(0), lambda a, c: a + c["cells"])
    weighted = F.aggregate("_clones", F.lit(0), lambda a, c: a + c["cells"] * c["abn"])
    counts = F.when(any_clone, most["counts"]).when(free, F.col("_free")).otherwise(zero)
    by_text = F.when(complex_text, 3).when(free, _total(F.col("_free"))).otherwise(0)
    df = df.withColumns(
        {
            "_counts": counts,
            "has_idem": F.when(any_clone, F.exists("_own", lambda c: c["idem"]).cast("int")).otherwise(0),
            "clone_count": F.when(listed, F.size("_clones")).when(F.col("_norm").isNotNull(), 1).otherwise(0),
            "total_cell_count": F.when(listed, cells).when(F.col("_norm").isNotNull(), 1).otherwise(0),
            "main_clone_cell_count": F.when(any_clone, main["cells"]).when(listed, 0).when(F.col("_norm").isNotNull(), 1).otherwise(0),
            "main_clone_abnormality_count": F.when(any_clone, main["abn"]).when(listed, 0).otherwise(F.coalesce(by_text, F.lit(0))),
            "num_cyto_abnormalities": F.when(listed, F.coalesce(F.try_divide(weighted.cast("double"), cells.cast("double")), F.lit(0.0))).otherwise(F.coalesce(by_text, F.lit(0)).cast("double")),
        }
    )
    df = df.withColumns({n: F.coalesce(F.get("_counts", F.lit(i)), F.lit(0)) for i, n in enumerate(_NAMES)})
    return df.drop("_pieces", "_own", "_clones", "_free", "_counts", "_most", "_cells")


def cytogenetics(df: DataFrame, text: str = "CYTOGENETICS", key: str = "ID") -> DataFrame:
    """The whole block: key, cyto_is_missing, and all features sorted by name; the features of a missing karyotype are NULL.

    Texts repeat, so each distinct one is parsed once and joined back (by broadcast if the written table is small, else Spark splits what is
    skewed)."""
    return with_cytogenetics(df.select(key, text), text).drop(text)


def with_cytogenetics(df: DataFrame, text: str = "CYTOGENETICS") -> DataFrame:
    """The rows with those features of `cytogenetics` that they lack, joined by text alone."""
    parsed = settle(_parsed(df.select(text).filter(F.col(text).isNotNull()).distinct(), text)).withColumnRenamed(text, "_text")
    rows = df.join(parsed.withColumnsRenamed({c: f"_made_{c}" for c in parsed.columns if c != "_text"}), F.col(text) == F.col("_text"), "left")
    made = {c: F.col(f"_made_{c}") for c in parsed.columns if c != "_text"} | {"cyto_is_missing": F.col(text).isNull().cast("int")}
    return rows.select(*df.columns, *[made[c].alias(c) for c in sorted(made) if c not in df.columns])


def _parsed(texts: DataFrame, text: str) -> DataFrame:
    """All features of each karyotype text."""
    out = clones(texts, text)
    t = F.col("_norm")
    has = lambda p: flag(t.rlike("(?i)" + p))
    n = F.regexp_extract(t, r"^\s*(\d+)", 1).try_cast("double")
    lows, highs = (F.transform(F.regexp_extract_all(t, F.lit(r"(\d{1,2})\s*[-~]\s*(\d{1,2})"), F.lit(g)), lambda x: x.cast("double")) for g in (1, 2))
    ranged = F.size(lows) > 0
    cp = F.transform(F.regexp_extract_all(t, F.lit(r"\[cp(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    sex = F.when(t.rlike("(?i)XY"), 1).when(t.rlike("(?i)XX"), 0)
    gain, loss = F.regexp_count(t, F.lit(r"(?i)\+\s*(?:x|y)(?:\[[^\]]+\])?")), F.regexp_count(t, F.lit(r"(?i)-\s*(?:x|y)(?:\[[^\]]+\])?"))
    structural = reduce(Column.__add__, [F.col(c) for c in STRUCTURAL])
    mono = F.regexp_count(t, F.lit(r"-(?:[1-9]|1\d|2[0-2])(?![0-9])"))
    out = out.withColumns({name: has(p) for name, p in SPECIFIC_ABNORMALITIES.items()})
    out = out.withColumns(
        {
            "chromosome_count": n, "hypodiploidy": flag(n < 46), "hyperdiploidy": flag(n >= 49), "near_triploidy": flag(n.between(60, 80)),
            "chromosome_count_min": F.array_min(lows), "chromosome_count_max": F.array_max(highs),
            "chromosome_range_span": F.array_max(highs) - F.array_min(lows), "chromosome_range_detected": flag(ranged),
            "sex_chromosomes": sex, "SEX_XX": flag(sex == 0), "SEX_XY": flag(sex == 1), "SEX_UNKNOWN": sex.isNull().cast("int"),
            "sex_chromosome_gain_count": gain, "sex_chromosome_loss_count": loss, "sex_chromosome_abnormality_flag": flag(gain + loss > 0),
            "normal_karyotype": flag(t.rlike(r"(?i)^\s*46\s*,\s*X[XY]\s*(\[.+\])?$|\bnormal\b") & (F.col("num_cyto_abnormalities") == 0)),
            "del_5q": F.col("del_5q_or_mono5"), "monosomy_7": F.col("monosomy_7_or_del7q"), "del_17p": F.col("del_17p_or_i17q"),
            "structural_count": structural, "numerical_count": F.col("n_plus") + F.col("n_minus"),
            "complex_karyotype": flag(F.col("num_cyto_abnormalities") >= COMPLEX_FROM),
            "has_derivative_chromosome": flag(F.col("n_der") > 0), "has_marker_chromosome": flag(F.col("n_mar") > 0),
            "has_ring_chromosome": flag(F.col("n_ring") > 0), "has_double_minutes": flag(F.col("n_dmin") > 0),
            "incomplete_karyotype": flag(t.rlike(r"\binc\b|incomplete")),
            "cp_max": F.coalesce(F.array_max(cp), F.lit(0)), "cp_any": flag(F.size(cp) > 0),
            "monosomal_karyotype": flag((mono >= 2) | ((mono == 1) & (structural > 0))),
        }
    )
    out = out.withColumn("any_adverse_cyto", F.greatest("del_5q_or_mono5", "monosomy_7_or_del7q", "del_17p_or_i17q", "rearr_3q26", "monosomal_karyotype"))
    adverse, favorable = (F.col("any_adverse_cyto") == 1) | (F.col("complex_karyotype") == 1), F.coalesce(t.rlike("(?i)" + FAVORABLE_CYTO), F.lit(False))
    out = out.withColumns({"eln_cyto_adverse": adverse.cast("int"), "eln_cyto_favorable": (favorable & ~adverse).cast("int"), "eln_cyto_intermediate": (~favorable & ~adverse).cast("int")})
    return out.drop("_norm")


def quick_risk(df: DataFrame, text: str = "CYTOGENETICS") -> DataFrame:
    """Three flags from simple patterns; adverse beats favorable, an empty text sets none."""
    t = F.coalesce(F.col(text), F.lit(""))
    favorable = t.rlike("(?i)" + FAVORABLE_CYTO + r"|t\s*\(\s*15\s*;\s*17\s*\)")
    adverse = t.rlike(r"(?i)complex|-\s*7(?![0-9])|-\s*5(?![0-9])|del\s*\(\s*17\s*\)\s*\(p|inv\s*\(\s*3\s*\)")
    said = F.trim(t) != ""
    return df.withColumns({"aux_cyto_adverse": (said & adverse).cast("int"), "aux_cyto_favorable": (said & favorable & ~adverse).cast("int"), "aux_cyto_intermediate": (said & ~favorable & ~adverse).cast("int")})
