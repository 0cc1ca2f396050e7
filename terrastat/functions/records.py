"""Record-level derivations R1-R14 as Column expressions.

Each function returns a ``Column`` over the wide incidence row, so a whole
record enrichment is one ``select``: no shuffle, no Python UDF. Thresholds,
labels and mapping tables are parameters whose defaults are the reference's
values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_COLS = [f"m{i:02d}" for i in range(1, 13)]

# --- Fixed values that must equal the reference's results -----------------
SETTLEMENT_RURAL_BELOW = 15000
SETTLEMENT_URBAN_UPTO = 250000
SETTLEMENT_LABELS = ("Rural", "Urbano", "Megalópolis")
MONTH_NAMES = ("ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO",
               "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE")
RISK_HIGH = 50.0
RISK_MEDIUM = 20.0
RISK_LABELS = ("Alto", "Medio", "Bajo")
TREND_LABELS = ("Alza Criminal en Semestre 2", "Reducción Criminal en Semestre 2",
                "Criminalidad Estable", "Datos Incompletos")
PATTERN_LABELS = ("Crónico (Requiere vigilancia permanente)",
                  " Intermitente (Vigilancia regular)",
                  " Estacional / Esporádico (Operativos específicos)",
                  " Nulo", "Desconocido")
PATTERN_CHRONIC_MIN = 10
PATTERN_INTERMITTENT_MIN = 4
# legal good -> crime class, and class -> statistical weight
LEGAL_GOOD_CLASS = {
    "La vida y la Integridad corporal": "violent",
    "Libertad personal": "violent",
    "El patrimonio": "patrimonial",
    "La familia": "family",
    "La libertad y la seguridad sexual": "sexual",
}
CLASS_WEIGHT = {"violent": 10, "patrimonial": 3, "family": 6, "sexual": 9, "other": 1}
DEFAULT_YEAR = 2015
# --------------------------------------------------------------------------

# The star-schema fixture's legal goods are part types; this parameter table
# gives them the same five classes (FIXTURES.md §2.2).
FIXTURE_LEGAL_GOOD_CLASS = {
    "ECONOMY": "violent", "LARGE": "violent", "MEDIUM": "patrimonial",
    "PROMO": "family", "SMALL": "sexual",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate_per_100k(total, population) -> Column:
    """total/pop*1e5 where pop > 0, else 0 (null pop -> 0).

    Guarded so ANSI mode never sees a zero divisor.
    """
    t, p = _c(total), _c(population)
    return F.when(p > 0, t.cast("double") / p * F.lit(100000.0)).otherwise(F.lit(0.0))


def settlement_class(population="population", rural_below: int = SETTLEMENT_RURAL_BELOW,
                     urban_upto: int = SETTLEMENT_URBAN_UPTO,
                     labels=SETTLEMENT_LABELS) -> Column:
    """< 15000 Rural, <= 250000 Urbano, else Megalópolis (null falls
    through to the last class, as comparisons with null are false)."""
    p = _c(population)
    return (F.when(p < rural_below, F.lit(labels[0]))
            .when(p <= urban_upto, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def quarter_of_month(month="month") -> Column:
    """R2: ((m - 1) div 3) + 1."""
    return (F.floor((_c(month) - 1) / 3) + 1).cast("int")


def month_name(month="month", names=MONTH_NAMES) -> Column:
    """Month number -> name (null outside 1..12)."""
    m = _c(month)
    arr = F.array(*[F.lit(n) for n in names])
    return F.when((m >= 1) & (m <= 12), F.element_at(arr, m.cast("int")))


def months_array(cols=MONTH_COLS) -> Column:
    """R4 nested form: ordered array of monthly counts (index = month)."""
    return F.array(*[_c(c) for c in cols])


def months_struct_array(cols=MONTH_COLS) -> Column:
    """R4 nested form as (month, cases) structs."""
    return F.array(*[F.struct(F.lit(i).alias("month"), _c(c).alias("cases"))
                     for i, c in enumerate(cols, start=1)])


def peak_month(cols=MONTH_COLS) -> Column:
    """Month of the largest count, earliest month on ties; null when the
    record has no counts."""
    arr = months_array(cols)
    pos = F.array_position(arr, F.array_max(arr))
    return F.when(F.array_max(arr).isNotNull(), pos.cast("int"))


def peak_cases(cols=MONTH_COLS) -> Column:
    return F.array_max(months_array(cols))


def risk_level(rate="rate_100k", high: float = RISK_HIGH, medium: float = RISK_MEDIUM,
               labels=RISK_LABELS) -> Column:
    """>= high Alto, >= medium Medio, else Bajo."""
    r = _c(rate)
    return (F.when(r >= high, F.lit(labels[0]))
            .when(r >= medium, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def _row_sum(cols) -> Column:
    return reduce(lambda a, b: a + b, [_c(c) for c in cols])


def half_year_trend(cols=MONTH_COLS, labels=TREND_LABELS) -> Column:
    """Second half vs first half; incomplete unless all 12 counts exist."""
    complete = reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in cols])
    s1, s2 = _row_sum(cols[:6]), _row_sum(cols[6:])
    return (F.when(~complete, F.lit(labels[3]))
            .when(s2 > s1, F.lit(labels[0]))
            .when(s1 > s2, F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def crime_class(legal_good="legal_good", mapping: dict | None = None,
                other: str = "other") -> Column:
    """Legal good -> class through a parameter table (default: the
    reference's taxonomy)."""
    mapping = LEGAL_GOOD_CLASS if mapping is None else mapping
    g = _c(legal_good)
    by_class: dict[str, list[str]] = {}
    for good, cls in mapping.items():
        by_class.setdefault(cls, []).append(good)
    expr = None
    for cls, goods in by_class.items():
        cond = g.isin(*goods)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def class_weight(cls="crime_class", weights: dict | None = None) -> Column:
    """Statistical weight of the class (unknown class -> 'other')."""
    weights = CLASS_WEIGHT if weights is None else weights
    c = _c(cls)
    expr = None
    for name, w in weights.items():
        if name == "other":
            continue
        expr = (F.when(c == name, F.lit(w)) if expr is None
                else expr.when(c == name, F.lit(w)))
    default = F.lit(weights.get("other", 1))
    return (default if expr is None else expr.otherwise(default)).cast("int")


def urgency_index(rate="rate_100k", weight="weight") -> Column:
    """Rate x weight."""
    return _c(rate) * _c(weight)


def active_months(cols=MONTH_COLS) -> Column:
    return _row_sum([F.when(_c(c) > 0, 1).otherwise(0) for c in cols])


def occurrence_pattern(cols=MONTH_COLS, labels=PATTERN_LABELS,
                       chronic_min: int = PATTERN_CHRONIC_MIN,
                       intermittent_min: int = PATTERN_INTERMITTENT_MIN) -> Column:
    """Months with cases > 0: >= 10 chronic, >= 4 intermittent, >= 1
    seasonal, 0 nulo; a record with no counts at all is 'Desconocido'."""
    none = reduce(lambda a, b: a & b, [_c(c).isNull() for c in cols])
    n = active_months(cols)
    return (F.when(none, F.lit(labels[4]))
            .when(n >= chronic_min, F.lit(labels[0]))
            .when(n >= intermittent_min, F.lit(labels[1]))
            .when(n >= 1, F.lit(labels[2]))
            .otherwise(F.lit(labels[3])))
