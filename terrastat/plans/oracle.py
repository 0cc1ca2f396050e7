"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written as plain SQL over the driver's pre-registered parquet views. The CTE
prefix rebuilds the fixture views (muni, inc, incidence, mart, points)
independently of the Spark code. Derived doubles are rounded to 6 digits, as
on the Spark side.
"""

from __future__ import annotations

MONTHS = [f"m{i:02d}" for i in range(1, 13)]
FEATURES = [f"Brand_{i}" for i in range(1, 26)]  # the fixture's 25 brands
CONTRACT = ["Clave_Ent", "Entidad", "Cve_Municipio", "Municipio", "Bien_juridico_afectado",
            "Tipo_de_delito", "Subtipo_de_delito", "Modalidad", "Enero", "Febrero", "Marzo",
            "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre",
            "Diciembre", "Total_Anual", "POB_TOTAL"]
CANON = ["state_key", "state", "muni_key", "muni", "legal_good", "crime_type", "subtype",
         "modality", *MONTHS, "total", "population"]

_month_sums = ",\n    ".join(
    f"CAST(SUM(CASE WHEN month(l_shipdate) = {i} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS {m}"
    for i, m in enumerate(MONTHS, start=1))

MUNI = """muni AS (
  SELECT CAST(s_suppkey AS BIGINT) AS muni_key, s_name AS muni, n_nationkey AS state_key, n_name AS state,
    CAST(FLOOR(((s_acctbal + 1000) / 11000) * ((s_acctbal + 1000) / 11000) * ((s_acctbal + 1000) / 11000)
               * 1500000) AS BIGINT) AS population
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

INC = f"""inc AS (
  SELECT CAST(l_suppkey AS BIGINT) AS muni_key, p_type AS legal_good, l_linestatus AS modality,
    CAST(year(l_shipdate) AS INTEGER) AS year, {_month_sums},
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4)"""

INCIDENCE = f"""incidence AS (
  SELECT m.state_key, m.state, i.muni_key, m.muni, i.legal_good, i.legal_good AS crime_type,
    i.legal_good AS subtype, i.modality, {', '.join('i.' + m for m in MONTHS)}, i.total, m.population,
    CASE WHEN m.population > 0 THEN CAST(i.total AS DOUBLE) / m.population * 100000.0 ELSE 0.0 END AS rate_100k,
    i.year
  FROM inc i LEFT JOIN muni m ON i.muni_key = m.muni_key)"""

MART_LONG = """mart_long AS (
  SELECT CAST(l_suppkey AS BIGINT) AS muni_key, replace(p_brand, '#', '_') AS feature,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

_pivot = ",\n    ".join(
    f"CAST(COALESCE(SUM(CASE WHEN l.feature = '{f}' THEN l.value END), 0) AS BIGINT) AS {f}" for f in FEATURES)
MART = f"""mart AS (
  SELECT m.muni_key, m.muni, m.state, m.population,
    {_pivot}
  FROM muni m LEFT JOIN mart_long l ON m.muni_key = l.muni_key
  GROUP BY m.muni_key, m.muni, m.state, m.population)"""

_rates = ", ".join(
    f"CASE WHEN population > 0 THEN CAST({f} AS DOUBLE) / population * 100000.0 ELSE 0.0 END AS {f}"
    for f in FEATURES)
RATES = f"""rates AS (
  SELECT muni_key, muni, population, state, {_rates}
  FROM mart WHERE population >= 5000)"""

_unpivot = " UNION ALL ".join(
    f"SELECT muni_key, muni, population, state, {i} AS position, '{f}' AS feature, {f} AS rate FROM rates"
    for i, f in enumerate(FEATURES))
RATES_LONG = f"rates_long AS ({_unpivot})"

POP_LONG = """pop_now AS (
  SELECT muni_key, 'Múnicipio ' || muni AS muni, state_key, 'Hombres' AS sex,
    CAST(FLOOR(population / 2) AS BIGINT) AS population FROM muni
  UNION ALL
  SELECT muni_key, 'Múnicipio ' || muni AS muni, state_key, 'Mujeres' AS sex,
    population - CAST(FLOOR(population / 2) AS BIGINT) AS population FROM muni
  UNION ALL
  SELECT muni_key, 'Múnicipio ' || muni AS muni, state_key, 'Total' AS sex, population FROM muni),
pop_long AS (
  SELECT *, 2015 AS year FROM pop_now
  UNION ALL
  SELECT muni_key, muni, state_key, sex, CAST(FLOOR(population / 2) AS BIGINT) AS population, 2010 AS year
  FROM pop_now)"""

POP_CLEAN = """pop_clean AS (
  SELECT muni_key, MIN(strip_accents(muni)) AS muni, CAST(SUM(population) AS BIGINT) AS population
  FROM pop_long WHERE year = 2015 AND sex <> 'Total' GROUP BY muni_key)"""

POINTS = """points AS (
  SELECT k, (n - mn) / sn AS x, (a - ma) / sa AS y
  FROM (SELECT o_custkey AS k, CAST(COUNT(*) AS DOUBLE) AS n, AVG(o_totalprice) AS a FROM orders GROUP BY o_custkey) r
  CROSS JOIN (SELECT AVG(n) AS mn, STDDEV_POP(n) AS sn, AVG(a) AS ma, STDDEV_POP(a) AS sa
    FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(o_totalprice) AS a FROM orders GROUP BY o_custkey) q) s)"""

ROLLUP = """rollup AS (
  SELECT muni_key, muni, population, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total,
    CASE WHEN population > 0 THEN CAST(COALESCE(SUM(total), 0) AS DOUBLE) / population * 100000.0 ELSE 0.0 END
      AS rate_100k
  FROM incidence WHERE muni_key IS NOT NULL AND muni IS NOT NULL AND population IS NOT NULL
  GROUP BY muni_key, muni, population)"""

PROLLUP = """prollup AS (
  SELECT muni_key, muni, state, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total, MAX(population) AS population
  FROM incidence WHERE muni_key IS NOT NULL AND muni IS NOT NULL AND state IS NOT NULL
  GROUP BY muni_key, muni, state)"""

CURVE = """curve AS (
  SELECT r.*, CASE WHEN population > 0 THEN CAST(total AS DOUBLE) / population * 100000.0 ELSE 0.0 END AS rate_100k,
    CAST(row_number() OVER (ORDER BY total DESC, muni_key) AS BIGINT) AS rank,
    CAST(SUM(total) OVER (ORDER BY total DESC, muni_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
      AS cum_total,
    (SELECT SUM(total) FROM prollup) AS grand
  FROM prollup r)"""

SETTLE = ("CASE WHEN population < 15000 THEN 'Rural' WHEN population <= 250000 THEN 'Urbano' "
          "ELSE 'Megalópolis' END")

CONT = f"""tagged AS (
  SELECT legal_good, {SETTLE} AS settlement, total FROM incidence WHERE legal_good IS NOT NULL),
goods AS (SELECT DISTINCT legal_good FROM tagged),
classes AS (SELECT * FROM (VALUES ('Rural'), ('Urbano'), ('Megalópolis')) t(settlement)),
cells AS (
  SELECT g.legal_good, c.settlement,
    CAST(COALESCE((SELECT SUM(t.total) FROM tagged t WHERE t.legal_good = g.legal_good
                   AND t.settlement = c.settlement), 0) AS BIGINT) AS observed
  FROM goods g, classes c),
rmarg AS (SELECT legal_good, SUM(observed) AS r FROM cells GROUP BY legal_good),
cmarg AS (SELECT settlement, SUM(observed) AS c FROM cells GROUP BY settlement),
ct AS (
  SELECT x.legal_good, x.settlement, x.observed FROM cells x
  JOIN rmarg USING (legal_good) JOIN cmarg USING (settlement) WHERE r > 0 AND c > 0),
ex AS (
  SELECT ct.*, CAST(r2.r AS DOUBLE) * c2.c / (SELECT SUM(observed) FROM ct) AS expected
  FROM ct JOIN (SELECT legal_good, SUM(observed) AS r FROM ct GROUP BY 1) r2 USING (legal_good)
  JOIN (SELECT settlement, SUM(observed) AS c FROM ct GROUP BY 1) c2 USING (settlement)),
chi AS (
  SELECT *, CASE WHEN dof = 1 THEN yates ELSE plain END AS chi2 FROM (
    SELECT SUM((observed - expected) * (observed - expected) / expected) AS plain,
      SUM(GREATEST(ABS(observed - expected) - 0.5, 0.0) * GREATEST(ABS(observed - expected) - 0.5, 0.0) / expected)
        AS yates,
      CAST((COUNT(DISTINCT legal_good) - 1) * (COUNT(DISTINCT settlement) - 1) AS INTEGER) AS dof,
      CAST(LEAST(COUNT(DISTINCT legal_good) - 1, COUNT(DISTINCT settlement) - 1) AS INTEGER) AS min_dim,
      CAST(SUM(observed) AS BIGINT) AS n
    FROM ex) q),
pval AS (
  SELECT chi.*, exp(-chi2 / 2) * (
    SELECT SUM(exp(i * ln(chi2 / 2) - lgamma(i + 1))) FROM range(0, CAST(dof / 2 AS BIGINT)) t(i)) AS p_value,
    CASE WHEN min_dim > 0 AND n > 0 THEN sqrt(chi2 / (n * min_dim)) END AS cramers_v
  FROM chi)"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (MUNI, INC, INCIDENCE)
KEYS = "muni_key, legal_good, modality, year"
R6 = "round({0}, 6) AS {1}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


_contract_sel = ", ".join(f"{c} AS {r}" for c, r in zip(CANON, CONTRACT))
_peak_arr = "[" + ", ".join(MONTHS) + "]"
_month_names = "['ENERO','FEBRERO','MARZO','ABRIL','MAYO','JUNIO','JULIO','AGOSTO','SEPTIEMBRE','OCTUBRE','NOVIEMBRE','DICIEMBRE']"
_peak = f"list_position({_peak_arr}, list_max({_peak_arr}))"
_s1 = " + ".join(MONTHS[:6])
_s2 = " + ".join(MONTHS[6:])
_active = " + ".join(f"CASE WHEN {m} > 0 THEN 1 ELSE 0 END" for m in MONTHS)
_trend = (f"CASE WHEN {_s2} > {_s1} THEN 'Alza Criminal en Semestre 2' "
          f"WHEN {_s1} > {_s2} THEN 'Reducción Criminal en Semestre 2' ELSE 'Criminalidad Estable' END")
_pattern = (f"CASE WHEN ({_active}) >= 10 THEN 'Crónico (Requiere vigilancia permanente)' "
            f"WHEN ({_active}) >= 4 THEN ' Intermitente (Vigilancia regular)' "
            f"WHEN ({_active}) >= 1 THEN ' Estacional / Esporádico (Operativos específicos)' ELSE ' Nulo' END")
_risk = "CASE WHEN rate_100k >= 50.0 THEN 'Alto' WHEN rate_100k >= 20.0 THEN 'Medio' ELSE 'Bajo' END"
_class = ("CASE WHEN legal_good IN ('ECONOMY', 'LARGE') THEN 'violent' WHEN legal_good = 'MEDIUM' THEN 'patrimonial' "
          "WHEN legal_good = 'PROMO' THEN 'family' WHEN legal_good = 'SMALL' THEN 'sexual' ELSE 'other' END")
_weight = ("CASE WHEN legal_good IN ('ECONOMY', 'LARGE') THEN 10 WHEN legal_good = 'MEDIUM' THEN 3 "
           "WHEN legal_good = 'PROMO' THEN 6 WHEN legal_good = 'SMALL' THEN 9 ELSE 1 END")

ENRICHED = f"""enriched AS (
  SELECT year, state, muni_key, muni, legal_good, subtype, modality, total, population, rate_100k,
    {SETTLE} AS settlement, {_class} AS crime_class, CAST({_weight} AS INTEGER) AS weight,
    rate_100k * {_weight} AS urgency, {_risk} AS risk,
    CAST({_peak} AS INTEGER) AS peak_month, {_month_names}[{_peak}] AS peak_month_name,
    list_max({_peak_arr}) AS peak_cases, {_trend} AS trend, {_pattern} AS pattern
  FROM incidence)"""

_months_long = " UNION ALL ".join(
    f"SELECT {KEYS}, {i} AS month, {m} AS cases FROM incidence" for i, m in enumerate(MONTHS, start=1))
MONTHS_LONG = f"months_long AS ({_months_long})"

LAB4 = "lab4 AS (SELECT *, muni_key % 4 AS cluster FROM rates)"
LAB4_LONG = "lab4_long AS (SELECT *, muni_key % 4 AS cluster FROM rates_long)"
GSTATS = """gstats AS (
  SELECT feature, position, AVG(rate) AS gm, STDDEV_SAMP(rate) AS gs FROM rates_long GROUP BY feature, position)"""
CMEANS = """cmeans AS (
  SELECT cluster, feature, position, AVG(rate) AS cm FROM lab4_long GROUP BY cluster, feature, position)"""
ZS = """zs AS (
  SELECT c.cluster, c.feature, c.position, (c.cm - g.gm) / (g.gs + 1e-9) AS z
  FROM cmeans c JOIN gstats g USING (feature, position))"""
NAMES = """top AS (
  SELECT cluster, feature, z FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, position) AS rn FROM zs) WHERE rn = 1),
csum AS (
  SELECT cluster, CAST(COUNT(*) AS BIGINT) AS members, AVG(population) AS mean_population FROM lab4 GROUP BY cluster),
names AS (
  SELECT s.cluster, s.members, s.mean_population, t.feature AS specialty, t.z AS top_z,
    CASE WHEN t.z < 0 THEN 'Perfil Pacifico' ELSE 'Foco: ' || replace(t.feature, '_', ' ') END
      || ' (N=' || CAST(s.members AS VARCHAR) || ' | Pob: '
      || CAST(CAST(round_even(s.mean_population / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'k)' AS cluster_name
  FROM csum s JOIN top t USING (cluster))"""
PROFILES = """profiles AS (
  SELECT c.cluster, n.cluster_name, c.position, c.feature, c.cm AS mean_rate
  FROM cmeans c JOIN names n USING (cluster))"""

DBS = """dbs AS (
  SELECT *, CAST(CASE WHEN muni_key % 5 = 0 THEN -1 ELSE muni_key % 3 END AS BIGINT) AS cluster FROM rates)"""
OUT_Z = """outz AS (
  SELECT muni_key, muni, population, state, feature, position, (rate - gm) / (gs + 1e-9) AS z
  FROM rates_long JOIN gstats USING (feature, position)
  WHERE muni_key IN (SELECT muni_key FROM dbs WHERE cluster = -1)),
anom AS (
  SELECT muni_key, muni, population, state, replace(feature, '_', ' ') AS main_anomaly, z AS max_z FROM (
    SELECT *, row_number() OVER (PARTITION BY muni_key ORDER BY z DESC, position) AS rn FROM outz) WHERE rn = 1)"""

EMB_DIST = """pairs AS (
  SELECT a.vec_id AS i, a.{lab} AS li, b.{lab} AS lj,
    sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
      lambda t: (CAST(a.embedding[t] AS DOUBLE) - CAST(b.embedding[t] AS DOUBLE)) ^ 2))) AS d
  FROM {src} a JOIN {src} b ON a.{grp} = b.{grp}),
per AS (
  SELECT i, li, lj, SUM(d) AS ds, COUNT(*) AS c FROM pairs GROUP BY i, li, lj),
ab AS (
  SELECT i, MAX(CASE WHEN li = lj THEN c END) AS n_own, MAX(CASE WHEN li = lj THEN ds END) AS d_own,
    MIN(CASE WHEN li <> lj THEN ds / c END) AS b {grp_sel}
  FROM per GROUP BY i {grp_by}),
sil AS (
  SELECT *, CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
    WHEN GREATEST(d_own / (n_own - 1), b) > 0 THEN (b - d_own / (n_own - 1)) / GREATEST(d_own / (n_own - 1), b)
    ELSE 0.0 END AS s FROM ab)"""


def _dbscan_sql(eps: float, min_samples: int, points: str = POINTS, coords: tuple | None = ("x", "y"),
                counted: bool = False) -> str:
    near = (" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in coords) if coords else
            "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")
    count = ", CAST(nb.cnt AS BIGINT) AS neighbours" if counted else ""
    return "WITH RECURSIVE " + w(points, f"""pairs AS (
  SELECT a.k AS i, b.k AS j FROM points a JOIN points b ON {near} <= {eps * eps})""",
             f"""nb AS (SELECT i, COUNT(*) AS cnt FROM pairs GROUP BY i)""",
             f"""core AS (SELECT i FROM nb WHERE cnt >= {min_samples})""",
             """cedge AS (
  SELECT p.i, p.j FROM pairs p JOIN core c1 ON p.i = c1.i JOIN core c2 ON p.j = c2.i)""",
             """reach(root, v) AS (
  SELECT i, i FROM core
  UNION
  SELECT r.root, e.j FROM reach r JOIN cedge e ON r.v = e.i)""",
             """comp AS (SELECT v, MIN(root) AS c FROM reach GROUP BY v)""",
             """clab AS (SELECT v, CAST(DENSE_RANK() OVER (ORDER BY c) - 1 AS BIGINT) AS label FROM comp)""",
             """blab AS (SELECT p.i, MIN(cl.label) AS label FROM pairs p JOIN clab cl ON p.j = cl.v GROUP BY p.i)""")[5:] + \
        f"""SELECT p.k, CAST(COALESCE(cl.label, bl.label, -1) AS BIGINT) AS label, cl.label IS NOT NULL AS is_core{count}
FROM points p JOIN nb ON nb.i = p.k LEFT JOIN clab cl ON p.k = cl.v LEFT JOIN blab bl ON p.k = bl.i"""


SQUARINGS = 24  # powers up to 2**24 of the covariance: what is left is one component


def _pca_ctes(comps: int) -> list[str]:
    """PCA of ``feat`` (id, pos, v) without an eigenvalue routine: the covariance is
    squared again and again until only its leading component is left, which is then
    taken off. Gives ``eig`` (component, lam), ``trace`` and ``axis`` (component, i, v)."""
    out = ["fmean AS (SELECT pos, AVG(v) AS m FROM feat GROUP BY pos)",
           """cov1 AS MATERIALIZED (
  SELECT a.pos AS i, b.pos AS j, AVG((a.v - p.m) * (b.v - q.m)) AS v
  FROM feat a JOIN feat b ON a.id = b.id JOIN fmean p ON p.pos = a.pos JOIN fmean q ON q.pos = b.pos
  GROUP BY a.pos, b.pos)"""]
    for r in range(1, comps + 1):
        out += [f"""pow{r}(step, i, j, v) AS (
  SELECT 0, i, j, v / sqrt(SUM(v * v) OVER ()) FROM cov{r}
  UNION ALL
  SELECT step + 1, i, j, v / sqrt(SUM(v * v) OVER ()) FROM (
    SELECT a.step, a.i, b.j, SUM(a.v * b.v) AS v FROM pow{r} a JOIN pow{r} b ON a.j = b.i
    WHERE a.step < {SQUARINGS} GROUP BY a.step, a.i, b.j))""",
                f"""axis{r} AS MATERIALIZED (
  SELECT i, v / sqrt(SUM(v * v) OVER ()) * sign(arg_max(v, abs(v)) OVER ()) AS v
  FROM pow{r} WHERE step = {SQUARINGS} AND j = (
    SELECT i FROM pow{r} WHERE step = {SQUARINGS} AND i = j ORDER BY v DESC LIMIT 1))""",
                f"""lam{r} AS MATERIALIZED (
  SELECT SUM(x.v * c.v * y.v) AS lam FROM cov1 c JOIN axis{r} x ON x.i = c.i JOIN axis{r} y ON y.i = c.j)"""]
        if r < comps:
            out.append(f"""cov{r + 1} AS MATERIALIZED (
  SELECT c.i, c.j, c.v - l.lam * x.v * y.v AS v
  FROM cov{r} c JOIN axis{r} x ON x.i = c.i JOIN axis{r} y ON y.i = c.j, lam{r} l)""")
    out += ["eig AS (" + " UNION ALL ".join(
                f"SELECT {r} AS component, lam FROM lam{r}" for r in range(1, comps + 1)) + ")",
            "trace AS (SELECT SUM(v) AS t FROM cov1 WHERE i = j)",
            "axis AS (" + " UNION ALL ".join(
                f"SELECT {r} AS component, i, v FROM axis{r}" for r in range(1, comps + 1)) + ")"]
    return out


def _apart(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


LLOYD_STEPS = 60
KMEANS_SEED = 42


def _kmeans_ctes(ks: list[int]) -> list[str]:
    """K-Means of ``pts`` (id, x: DOUBLE[]) for each K: seeds drawn along the running
    sum of squared distances, then Lloyd steps. Gives ``klab`` (k, id, x, label, d)."""
    draw = [(KMEANS_SEED + j) * 0.6180339887498949 % 1.0 for j in range(max(ks))]
    out = ["seed_rank AS MATERIALIZED (SELECT id, x, row_number() OVER (ORDER BY id) AS rn, "
           "COUNT(*) OVER () AS n FROM pts)",
           f"seed0 AS MATERIALIZED (SELECT x FROM seed_rank WHERE rn = CAST(floor({draw[0]!r} * n) AS BIGINT) + 1)",
           f"far1 AS MATERIALIZED (SELECT r.id, r.x, {_apart('r.x', 's.x')} AS d FROM seed_rank r, seed0 s)"]
    for j in range(1, max(ks)):
        out.append(f"""seed{j} AS MATERIALIZED (
  SELECT x FROM (SELECT id, x, SUM(d) OVER (ORDER BY id) AS c, SUM(d) OVER () AS t FROM far{j})
  WHERE c > {draw[j]!r} * t ORDER BY id LIMIT 1)""")
        if j + 1 < max(ks):
            out.append(f"far{j + 1} AS MATERIALIZED (SELECT f.id, f.x, "
                       f"least(f.d, {_apart('f.x', 's.x')}) AS d FROM far{j} f, seed{j} s)")
    first = " UNION ALL ".join(f"SELECT {j} AS c, x FROM seed{j}" for j in range(max(ks)))
    near = "arg_min({val}, {{'d': " + _apart("p.x", "l.x") + ", 'c': l.c}})"
    return out + [
        f"ks AS (SELECT unnest([{', '.join(map(str, ks))}]) AS k)", f"seeds AS ({first})",
        f"""lloyd(k, step, c, x) AS (
  SELECT k, 0, c, x FROM ks JOIN seeds ON c < k
  UNION ALL
  SELECT k, step + 1, c, list(m ORDER BY dim) FROM (
    SELECT k, step, c, dim, AVG(v) AS m FROM (
      SELECT k, step, c, unnest(x) AS v, unnest(range(len(x))) AS dim FROM (
        SELECT l.k, l.step, p.id, p.x, {near.format(val='l.c')} AS c
        FROM lloyd l, pts p WHERE l.step < {LLOYD_STEPS} GROUP BY l.k, l.step, p.id, p.x))
    GROUP BY k, step, c, dim) GROUP BY k, step, c)""",
        f"""klab AS MATERIALIZED (
  SELECT l.k, p.id, p.x, {near.format(val='l.c')} AS label, MIN({_apart('p.x', 'l.x')}) AS d
  FROM lloyd l, pts p WHERE l.step = {LLOYD_STEPS} GROUP BY l.k, p.id, p.x)"""]


KMEANS_EVAL = f"""kpair AS (
  SELECT a.k, a.id, a.label AS li, b.label AS lj, SUM(sqrt({_apart('a.x', 'b.x')})) AS ds, COUNT(*) AS c
  FROM klab a JOIN klab b ON a.k = b.k GROUP BY a.k, a.id, a.label, b.label),
kab AS (
  SELECT k, id, MAX(CASE WHEN li = lj THEN c END) AS n, MAX(CASE WHEN li = lj THEN ds END) AS ds,
    MIN(CASE WHEN li <> lj THEN ds / c END) AS b FROM kpair GROUP BY k, id),
ksil AS (
  SELECT k, AVG(CASE WHEN n <= 1 OR b IS NULL OR greatest(ds / (n - 1), b) = 0 THEN 0.0
    ELSE (b - ds / (n - 1)) / greatest(ds / (n - 1), b) END) AS silhouette FROM kab GROUP BY k),
kev AS (SELECT k, SUM(d) AS inertia, ANY_VALUE(silhouette) AS silhouette
  FROM klab JOIN ksil USING (k) GROUP BY k)"""


def _mart_pca(comps: int) -> list[str]:
    """``feat`` from the scaled rates of the mart, and its PCA."""
    scaled = "feat AS (" + " UNION ALL ".join(
        f"SELECT muni_key AS id, {i} AS pos, CASE WHEN STDDEV_POP({f}) OVER () > 0 THEN "
        f"({f} - AVG({f}) OVER ()) / STDDEV_POP({f}) OVER () ELSE 0.0 END AS v FROM rates"
        for i, f in enumerate(FEATURES)) + ")"
    return [MUNI, MART_LONG, MART, RATES, scaled, *_pca_ctes(comps)]


def _pcs(comps: int) -> str:
    """``pcs`` (id, pc1...) of ``feat``."""
    pc = ", ".join(f"SUM(CASE WHEN component = {r} THEN f.v * a.v END) AS pc{r}"
                   for r in range(1, comps + 1))
    return f"pcs AS MATERIALIZED (SELECT f.id, {pc} FROM feat f JOIN axis a ON a.i = f.pos GROUP BY f.id)"


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + w(*parts)[5:]


def _sql() -> dict[str, str]:
    b = w(*BASE)
    q: dict[str, str] = {}
    q["etl_contract"] = b + f"SELECT {_contract_sel} FROM incidence"
    q["etl_round_trip"] = q["etl_contract"]
    q["profile_table"] = b + "SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(22 AS BIGINT) AS n_columns FROM incidence"
    q["profile_head"] = b + f"SELECT {_contract_sel} FROM incidence ORDER BY muni_key, legal_good, modality, {', '.join(MONTHS)}, total LIMIT 3"
    q["etl_clean_names"] = w(MUNI, POP_LONG) + \
        "SELECT muni_key, strip_accents(muni) AS muni, state_key, sex, population FROM pop_long"
    q["etl_annual_total"] = w(INC) + \
        f"SELECT {KEYS}, CAST({' + '.join(f'COALESCE({m}, 0)' for m in MONTHS)} AS BIGINT) AS annual_total, total FROM inc"
    q["etl_population"] = w(MUNI, POP_LONG, POP_CLEAN) + "SELECT * FROM pop_clean"
    q["etl_merge_rate"] = w(MUNI, INC, POP_LONG, POP_CLEAN) + (
        f"SELECT i.muni_key, i.legal_good, i.modality, i.year, i.total, p.population, "
        f"round(CASE WHEN p.population > 0 THEN CAST(i.total AS DOUBLE) / p.population * 100000.0 ELSE 0.0 END, 6) "
        f"AS rate_100k FROM inc i LEFT JOIN pop_clean p ON i.muni_key = p.muni_key")
    q["etl_merge_bucketed"] = q["etl_merge_rate"]
    cells = [f"COALESCE(CAST({c} AS VARCHAR), '')" for c in CONTRACT]
    word = [f"CASE WHEN k = 3 THEN 'n/d' ELSE {x} END" if c == "Marzo" else x
            for c, x in zip(CONTRACT, cells)]
    sep = " || ',' || "
    told = b + f", told AS (SELECT *, Cve_Municipio % 7 AS k FROM (SELECT {_contract_sel} FROM incidence))\n"
    q["etl_rejects"] = told + (
        f"SELECT CASE k WHEN 1 THEN {sep.join(cells[:-1])} "
        f"WHEN 2 THEN {sep.join(cells)} || ',9' ELSE {sep.join(word)} END AS record, "
        "CASE k WHEN 1 THEN 'too few fields' WHEN 2 THEN 'too many fields' ELSE 'not a number: Marzo' END "
        "AS reason FROM told WHERE k BETWEEN 1 AND 3")
    q["etl_accepted"] = told + f"SELECT {', '.join(CONTRACT)} FROM told WHERE k NOT BETWEEN 1 AND 3"
    q["etl_catalogue"] = b + (
        f"SELECT i.state_key, COALESCE('Edo. ' || n.n_name, trim(i.state)) AS state, i.muni_key, trim(i.legal_good) AS legal_good, "
        f"trim(i.modality) AS modality, i.year, COALESCE(i.m01, 0) AS m01, i.total "
        f"FROM incidence i LEFT JOIN nation n ON i.state_key = n.n_nationkey AND n.n_nationkey % 5 <> 0")
    q["etl_catalogue_unmatched"] = b + (
        f"SELECT i.state_key, i.muni_key, trim(i.legal_good) AS legal_good, trim(i.modality) AS modality, i.year "
        f"FROM incidence i WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = i.state_key "
        f"AND n.n_nationkey % 5 <> 0)")
    q["etl_partitioned_read"] = b + (
        f"SELECT state_key, state, {KEYS}, total, population FROM incidence WHERE state_key = 1")
    q["mart_pivot"] = w(MUNI, MART_LONG, MART) + "SELECT * FROM mart"
    q["etl_mart_csv"] = q["mart_pivot"]
    q["etl_latin1_read"] = w(MUNI, POP_LONG) + "SELECT muni_key, muni, year, sex, population FROM pop_long"

    q["settlement_class"] = w(MUNI) + f"SELECT muni_key, population, {SETTLE} AS settlement FROM muni"
    q["months_long"] = w(*BASE, MONTHS_LONG) + "SELECT * FROM months_long"
    q["quarter_totals"] = w(*BASE, MONTHS_LONG) + (
        "SELECT legal_good, CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter, CAST(SUM(cases) AS BIGINT) AS cases "
        "FROM months_long GROUP BY 1, 2")
    q["month_names"] = w(*BASE, MONTHS_LONG) + (
        f"SELECT month, {_month_names}[month] AS month_name, CAST(SUM(cases) AS BIGINT) AS cases "
        f"FROM months_long GROUP BY 1, 2")
    q["month_overflow"] = w(*BASE, MONTHS_LONG) + (
        f"SELECT {KEYS}, CAST(COUNT(*) AS BIGINT) AS n_counts FROM (SELECT * FROM months_long "
        f"UNION ALL SELECT * FROM months_long WHERE legal_good = 'PROMO') GROUP BY {KEYS} HAVING COUNT(*) > 12")
    q["peak_month"] = b + (
        f"SELECT {KEYS}, CAST({_peak} AS INTEGER) AS peak_month, {_month_names}[{_peak}] AS peak_month_name, "
        f"list_max({_peak_arr}) AS peak_cases FROM incidence")
    q["risk_level"] = b + f"SELECT {KEYS}, round(rate_100k, 6) AS rate_100k, {_risk} AS risk FROM incidence"
    q["half_year_trend"] = b + (
        f"SELECT {KEYS}, CAST({_s1} AS BIGINT) AS s1, CAST({_s2} AS BIGINT) AS s2, {_trend} AS trend FROM incidence")
    q["crime_class_weight"] = b + (
        f"SELECT {KEYS}, {_class} AS crime_class, CAST({_weight} AS INTEGER) AS weight FROM incidence")
    q["urgency_index"] = b + f"SELECT {KEYS}, round(rate_100k * {_weight}, 6) AS urgency FROM incidence"
    q["occurrence_pattern"] = b + (
        f"SELECT {KEYS}, CAST({_active} AS INTEGER) AS active_months, {_pattern} AS pattern FROM incidence")
    q["state_municipalities"] = w(MUNI) + (
        "SELECT state_key, state, muni_key, muni, CAST(row_number() OVER (PARTITION BY state_key, state "
        "ORDER BY muni, muni_key) AS INTEGER) AS position FROM muni")
    q["record_enriched"] = w(*BASE, ENRICHED) + (
        "SELECT year, state, muni_key, muni, legal_good, subtype, modality, total, population, "
        "round(rate_100k, 6) AS rate_100k, settlement, crime_class, weight, round(urgency, 6) AS urgency, risk, "
        "peak_month, peak_month_name, peak_cases, trend, pattern FROM enriched")

    q["sample_exact"] = w(INC) + (
        f"SELECT {KEYS}, total FROM inc ORDER BY CAST('0x' || substr(md5(concat_ws('|', '42', "
        f"CAST(muni_key AS VARCHAR), legal_good, modality, CAST(year AS VARCHAR))), 1, 15) AS BIGINT), {KEYS} LIMIT 500")
    q["filter_options"] = b + (
        "SELECT DISTINCT 'state' AS kind, state AS value FROM incidence WHERE state IS NOT NULL "
        "UNION ALL SELECT DISTINCT 'muni' AS kind, muni AS value FROM incidence WHERE state = 'NATION_1' "
        "UNION ALL SELECT DISTINCT 'legal_good' AS kind, legal_good AS value FROM incidence WHERE legal_good IS NOT NULL")
    q["filtered_records"] = b + (
        f"SELECT state, {KEYS}, total FROM incidence WHERE state = 'NATION_1' AND legal_good = 'PROMO'")
    q["filtered_records_clustered"] = q["filtered_records"]
    q["risk_counts"] = w(*BASE, ENRICHED) + (
        "SELECT l.risk, CAST(COALESCE(c.n, 0) AS BIGINT) AS records_at_level, "
        "(SELECT CAST(COUNT(*) AS BIGINT) FROM enriched) AS records "
        "FROM (VALUES ('Alto'), ('Medio'), ('Bajo')) l(risk) "
        "LEFT JOIN (SELECT risk, COUNT(*) AS n FROM enriched GROUP BY risk) c ON l.risk = c.risk")
    q["predominant_month"] = w(*BASE, ENRICHED) + (
        f"SELECT COALESCE((SELECT {_month_names}[peak_month] FROM (SELECT peak_month, COUNT(*) AS n FROM enriched "
        f"WHERE peak_cases > 0 GROUP BY peak_month ORDER BY n DESC, peak_month LIMIT 1)), 'Sin incidentes') "
        f"AS predominant_month, CAST(COALESCE((SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM enriched "
        f"WHERE peak_cases > 0 GROUP BY peak_month)), 0) AS BIGINT) AS records")
    q["record_cards"] = w(*BASE, ENRICHED) + (
        "SELECT muni || ' | ' || subtype || ' (' || modality || ')' AS title, muni_key, legal_good, modality, subtype, year, "
        "weight AS priority, round(urgency, 6) AS urgency, settlement, round(rate_100k, 6) AS rate_100k, risk, "
        "peak_month_name, peak_cases, trend, pattern FROM enriched ORDER BY muni_key, legal_good, modality, year LIMIT 50")
    q["kpi_total"] = b + "SELECT CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total_cases FROM incidence"
    q["kpi_municipalities"] = b + "SELECT CAST(COUNT(DISTINCT muni) AS BIGINT) AS municipalities FROM incidence"
    q["kpi_top_state"] = b + (
        "SELECT state AS top_state, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS volume FROM incidence "
        "WHERE state IS NOT NULL GROUP BY state ORDER BY volume DESC, state LIMIT 1")
    q["kpi_top_good"] = b + (
        "SELECT legal_good AS top_legal_good, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS volume FROM incidence "
        "WHERE legal_good IS NOT NULL GROUP BY legal_good ORDER BY volume DESC, legal_good LIMIT 1")

    rb = w(*BASE, ROLLUP)
    q["muni_rollup"] = rb + "SELECT muni_key, muni, population, total, round(rate_100k, 6) AS rate_100k FROM rollup"
    stats = []
    for c in ("total", "rate_100k", "population"):
        x = f"CAST({c} AS DOUBLE)"
        stats.append(
            f"SELECT '{c}' AS column, round(AVG({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS median, "
            f"round(STDDEV_SAMP({x}), 6) AS std, round(MIN({x}), 6) AS min, round(MAX({x}), 6) AS max, "
            f"round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.75), 6) AS q3, "
            f"round(skewness({x}), 6) AS skew, round(kurtosis({x}), 6) AS kurtosis FROM rollup")
    q["descriptive_stats"] = rb + " UNION ALL ".join(stats)
    labels = ["Media", "Mediana", "Desv. Est.", "Mínimo", "Máximo", "Q1 (25%)", "Q3 (75%)",
              "Asimetría", "Curtosis"]
    funcs = ["AVG({x})", "quantile_cont({x}, 0.5)", "STDDEV_SAMP({x})", "MIN({x})", "MAX({x})",
             "quantile_cont({x}, 0.25)", "quantile_cont({x}, 0.75)", "skewness({x})", "kurtosis({x})"]
    table = []
    for i, (lab, fn) in enumerate(zip(labels, funcs)):
        cols = ", ".join(f"round({fn.format(x=f'CAST({c} AS DOUBLE)')}, 6) AS {c}"
                         for c in ("total", "rate_100k", "population"))
        table.append(f"SELECT '{lab}' AS stat, {i} AS position, {cols} FROM rollup")
    q["descriptive_table"] = rb + " UNION ALL ".join(table)
    q["rate_histogram"] = rb + (
        ", mm AS (SELECT MIN(rate_100k) AS mn, MAX(rate_100k) AS mx FROM rollup)\n"
        "SELECT bin, round(mn + (bin - 1) * ((mx - mn) / 50), 6) AS bin_lo, round(mn + bin * ((mx - mn) / 50), 6) AS bin_hi, "
        "CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CAST(CASE WHEN mx > mn THEN LEAST(FLOOR((rate_100k - mn) / (mx - mn) * 50) + 1, 50) "
        "ELSE 1 END AS BIGINT) AS bin, mn, mx FROM rollup, mm WHERE rate_100k IS NOT NULL) GROUP BY bin, mn, mx")
    q["rate_box"] = rb + (
        ", qs AS (SELECT quantile_cont(rate_100k, 0.25) AS q1, quantile_cont(rate_100k, 0.5) AS med, "
        "quantile_cont(rate_100k, 0.75) AS q3 FROM rollup),\n"
        "f AS (SELECT q1, med, q3, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM qs)\n"
        "SELECT round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
        "round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence, "
        "round((SELECT MIN(rate_100k) FROM rollup WHERE rate_100k >= lo), 6) AS whisker_lo, "
        "round((SELECT MAX(rate_100k) FROM rollup WHERE rate_100k <= hi), 6) AS whisker_hi, "
        "(SELECT CAST(COUNT(*) AS BIGINT) FROM rollup WHERE rate_100k < lo OR rate_100k > hi) AS n_outliers FROM f")
    q["rate_outliers"] = rb + (
        ", qs AS (SELECT quantile_cont(rate_100k, 0.25) AS q1, quantile_cont(rate_100k, 0.75) AS q3 FROM rollup)\n"
        "SELECT muni_key, muni, population, total, round(rate_100k, 6) AS rate_100k FROM rollup, qs "
        "WHERE rate_100k < q1 - (q3 - q1) * 1.5 OR rate_100k > q3 + (q3 - q1) * 1.5")
    q["top_goods"] = b + (
        "SELECT legal_good, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total FROM incidence WHERE legal_good IS NOT NULL "
        "GROUP BY legal_good ORDER BY total DESC, legal_good LIMIT 10")
    q["top_rate_munis"] = rb + (
        "SELECT muni_key, muni, population, total, round(rate_100k, 6) AS rate_100k FROM rollup "
        "WHERE population > 5000 ORDER BY rate_100k DESC, muni_key LIMIT 10")
    q["pop_rate_points"] = rb + (
        "SELECT muni_key, muni, population, round(rate_100k, 6) AS rate_100k FROM rollup WHERE population > 5000")
    q["lorenz_curve"] = rb + (
        ", rk AS (SELECT row_number() OVER (ORDER BY total, muni_key) AS point, "
        "SUM(total) OVER (ORDER BY total, muni_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
        "COUNT(*) OVER () AS n, SUM(total) OVER () AS tot FROM rollup)\n"
        "SELECT CAST(0 AS BIGINT) AS point, 0.0 AS pop_pct, 0.0 AS cases_pct "
        "UNION ALL SELECT CAST(point AS BIGINT), round(point * 100.0 / n, 6), "
        "round(CASE WHEN tot <> 0 THEN cum * 100.0 / tot END, 6) FROM rk")
    q["gini"] = rb + (
        ", rk AS (SELECT total, row_number() OVER (ORDER BY total, muni_key) AS i FROM rollup)\n"
        "SELECT round(CASE WHEN SUM(total) <> 0 THEN 2.0 * CAST(SUM(CAST(i AS HUGEINT) * total) AS DOUBLE) / (COUNT(*) * CAST(SUM(total) AS DOUBLE)) "
        "- (COUNT(*) + 1.0) / COUNT(*) END, 6) AS gini, CAST(COUNT(*) AS BIGINT) AS municipalities FROM rk")

    pc = w(*BASE, PROLLUP, CURVE)
    curve_cols = ("rank, muni_key, muni, state, total, population, round(rate_100k, 6) AS rate_100k, cum_total, "
                  "round(CASE WHEN grand <> 0 THEN total * 100.0 / grand END, 6) AS share_pct, "
                  "round(CASE WHEN grand <> 0 THEN cum_total * 100.0 / grand END, 6) AS cum_pct")
    q["pareto_curve"] = pc + f"SELECT {curve_cols}, cum_total * 100 <= grand * 80 AS critical FROM curve"
    q["pareto_critical"] = pc + f"SELECT {curve_cols} FROM curve WHERE cum_total * 100 <= grand * 80"
    q["pareto_summary"] = pc + (
        "SELECT CAST(SUM(CASE WHEN cum_total * 100 <= grand * 80 THEN 1 ELSE 0 END) AS BIGINT) AS critical_count, "
        "CAST(COUNT(*) AS BIGINT) AS municipalities, "
        "round(CASE WHEN COUNT(*) > 0 THEN SUM(CASE WHEN cum_total * 100 <= grand * 80 THEN 1 ELSE 0 END) * 100.0 / COUNT(*) END, 6) "
        "AS territory_pct, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS grand_total FROM curve")
    q["pareto_rank"] = pc + (
        "SELECT rank, muni_key, round(CASE WHEN grand <> 0 THEN cum_total * 100.0 / grand END, 6) AS cum_pct FROM curve")
    q["pareto_top10"] = pc + (
        "SELECT rank, muni_key, muni, state, total, format('{:,}', total) AS total_display, "
        "round(CASE WHEN grand <> 0 THEN cum_total * 100.0 / grand END, 6) AS cum_pct FROM curve "
        "ORDER BY total DESC, muni_key LIMIT 10")

    cb = w(*BASE, CONT)
    q["contingency"] = cb + "SELECT legal_good, settlement, observed FROM ct"
    q["chi_square"] = cb + (
        "SELECT round(chi2, 6) AS chi2, dof, round(p_value, 6) AS p_value, "
        "CASE WHEN p_value > 0 THEN round(-log10(p_value), 4) END AS p_neglog10, n FROM pval")
    q["cramers_v"] = cb + "SELECT n, min_dim, round(cramers_v, 6) AS cramers_v FROM pval"
    q["residuals"] = cb + (
        "SELECT settlement, legal_good, round((observed - expected) / sqrt(expected), 6) AS residual FROM ex")
    q["hotspots"] = cb + (
        ", rs AS (SELECT settlement, legal_good, (observed - expected) / sqrt(expected) AS residual FROM ex)\n"
        "SELECT settlement, legal_good, round(residual, 6) AS residual, "
        "'🔴 En zona ' || upper(settlement) || ', el delito contra ''' || legal_good || ''' es anormalmente alto.' AS alert "
        "FROM rs WHERE residual > 2.0 ORDER BY residual DESC, settlement, legal_good LIMIT 3")
    q["column_profile"] = cb + (
        "SELECT legal_good, settlement, round(CASE WHEN c <> 0 THEN observed * 100.0 / c END, 6) AS pct "
        "FROM ct JOIN (SELECT settlement, SUM(observed) AS c FROM ct GROUP BY 1) USING (settlement)")
    q["dependence_diagnosis"] = cb + (
        "SELECT COALESCE(p_value < 0.05, false) AS related, CASE WHEN cramers_v IS NULL THEN NULL "
        "WHEN cramers_v < 0.1 THEN 'Débil (El entorno influye poco)' "
        "WHEN cramers_v < 0.3 THEN 'Moderada (El entorno es un factor importante)' "
        "ELSE 'Fuerte (El entorno determina el crimen)' END AS strength, round(cramers_v, 4) AS cramers_v, "
        "CASE WHEN p_value < 0.001 THEN '< 0.001' ELSE printf('%.4f', p_value) END AS p_text FROM pval")

    mb = w(MUNI, MART_LONG, MART, RATES)
    feats = ", ".join(FEATURES)
    q["features_filtered"] = w(MUNI, MART_LONG, MART) + "SELECT * FROM mart WHERE population >= 5000"
    roles = [("muni_key", "id", 0, "SUM(muni_key)"), ("muni", "id", 1, "MAX(NULL)"),
             ("population", "id", 2, "SUM(population)"), ("state", "id", 3, "MAX(NULL)")]
    roles += [(f, "feature", i, f"SUM({f})") for i, f in enumerate(FEATURES)]
    every = f"SUM({' + '.join(FEATURES)})"
    roles += [("Total", "excluded", "NULL", every), ("Robos_Totales", "excluded", "NULL", every)]
    q["feature_roles"] = w(MUNI, MART_LONG, MART) + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{r}' AS role, CAST({i} AS INTEGER) AS position, "
        f"CAST({x} AS BIGINT) AS total FROM mart" for c, r, i, x in roles)
    q["feature_rates"] = mb + "SELECT muni_key, muni, population, state, " + ", ".join(
        f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM rates"
    q["features_scaled"] = mb + ", st AS (SELECT " + ", ".join(
        f"AVG({f}) AS m_{f}, STDDEV_POP({f}) AS s_{f}" for f in FEATURES) + " FROM rates)\n" + \
        "SELECT muni_key, muni, population, state, " + ", ".join(
            f"round(CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} ELSE 0.0 END, 6) AS {f}" for f in FEATURES) + \
        " FROM rates, st"

    emb_all = EMB_DIST.format(lab="label", src="embeddings", grp="one", grp_sel="", grp_by="") \
        .replace("ON a.one = b.one", "ON true")
    q["silhouette_exact"] = w(emb_all) + "SELECT round(AVG(s), 6) AS silhouette FROM sil"
    sweep_src = ("sw AS (SELECT vec_id, embedding, k, vec_id % k AS lk FROM embeddings, "
                 "(SELECT range AS k FROM range(2, 9)) ks)")
    emb_sw = EMB_DIST.format(lab="lk", src="sw", grp="k", grp_sel=", k", grp_by=", k") \
        .replace("SELECT a.vec_id AS i,", "SELECT a.k AS k, a.vec_id AS i,") \
        .replace("SELECT i, li, lj, SUM(d) AS ds, COUNT(*) AS c FROM pairs GROUP BY i, li, lj",
                 "SELECT k, i, li, lj, SUM(d) AS ds, COUNT(*) AS c FROM pairs GROUP BY k, i, li, lj")
    q["silhouette_sweep"] = w(sweep_src, emb_sw) + \
        "SELECT CAST(k AS BIGINT) AS k, round(AVG(s), 6) AS silhouette FROM sil GROUP BY k"
    q["best_k"] = w(sweep_src, emb_sw) + (
        ", ev AS (SELECT CAST(k AS BIGINT) AS k, round(AVG(s), 6) AS silhouette FROM sil GROUP BY k)\n"
        "SELECT k AS best_k, silhouette AS best_silhouette FROM ev ORDER BY silhouette DESC, k LIMIT 1")

    cl = w(MUNI, MART_LONG, MART, RATES, RATES_LONG, LAB4, LAB4_LONG, GSTATS, CMEANS, ZS, NAMES, PROFILES)
    q["cluster_summary"] = w(MUNI, MART_LONG, MART, RATES, LAB4) + (
        "SELECT cluster, CAST(COUNT(*) AS BIGINT) AS members, round(AVG(population), 6) AS mean_population "
        "FROM lab4 GROUP BY cluster")
    q["cluster_zscores"] = cl + "SELECT cluster, position, feature, round(z, 6) AS z FROM zs"
    q["cluster_names"] = cl + (
        "SELECT cluster, members, round(mean_population, 6) AS mean_population, specialty, round(top_z, 6) AS top_z, "
        "cluster_name FROM names")
    q["cluster_members_named"] = cl + "SELECT muni_key, cluster, cluster_name FROM lab4 JOIN names USING (cluster)"
    q["cluster_profiles"] = cl + (
        "SELECT cluster, cluster_name, position, feature, round(mean_rate, 6) AS mean_rate FROM profiles")
    q["cluster_top3"] = cl + (
        "SELECT cluster, cluster_name, string_agg(replace(feature, '_', ' '), ', ' ORDER BY rn) AS top_features FROM ("
        "SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_rate DESC, position) AS rn FROM profiles) "
        "WHERE rn <= 3 GROUP BY cluster, cluster_name")
    q["cluster_heat"] = cl + (
        ", hf AS (SELECT feature FROM profiles GROUP BY feature, position ORDER BY SUM(mean_rate) DESC, position LIMIT 10)\n"
        "SELECT feature, cluster, cluster_name, round(mean_rate, 6) AS mean_rate FROM profiles "
        "WHERE feature IN (SELECT feature FROM hf)")

    q["dbscan_labels"] = _dbscan_sql(0.2, 10)
    dims = [f"e{i}" for i in range(5)]
    emb = "points AS (SELECT vec_id AS k, " + ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(dims)) + " FROM embeddings)"
    q["dbscan_high_dims"] = _dbscan_sql(0.12, 10, emb, tuple(dims), counted=True)
    q["descriptive_stats_sketch"] = w(INC) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({x} AS DOUBLE) AS q, COUNT({c}) AS n, true AS within FROM inc"
        for c in ("total", "m01", "m12") for x in (0.01, 0.25, 0.5, 0.75, 0.99))
    q["chi_square_odd"] = """WITH cells AS (
  SELECT p_type AS r, quarter(l_shipdate) AS c, CAST(COUNT(*) AS DOUBLE) AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
grid AS (
  SELECT a.r, b.c, COALESCE(x.o, 0) AS o, a.t AS rt, b.t AS ct, SUM(COALESCE(x.o, 0)) OVER () AS n
  FROM (SELECT r, SUM(o) AS t FROM cells GROUP BY r) a CROSS JOIN (SELECT c, SUM(o) AS t FROM cells GROUP BY c) b
  LEFT JOIN cells x ON x.r = a.r AND x.c = b.c),
stat AS (
  SELECT SUM((o - rt * ct / n) ^ 2 / (rt * ct / n)) AS chi2, ANY_VALUE(n) AS n,
    CAST((COUNT(DISTINCT r) - 1) * (COUNT(DISTINCT c) - 1) AS INTEGER) AS dof FROM grid),
half AS (SELECT *, chi2 / 2 AS x, dof / 2.0 AS a FROM stat)
SELECT round(chi2, 6) AS chi2, dof, CAST(n AS BIGINT) AS n,
  round(1 - exp(a * ln(x) - x - lgamma(a + 1)) * list_reduce(range(1, 4000), lambda s, k:
    {'t': s.t * x / (a + k), 's': s.s + s.t * x / (a + k)}, {'t': CAST(1 AS DOUBLE), 's': CAST(1 AS DOUBLE)}).s, 6) AS p_value
FROM half"""
    places = "places AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS position" for i, f in enumerate(FEATURES)) + ")"
    q["mart_sparse"] = w(MUNI, MART_LONG, places) + (
        "SELECT l.muni_key, CAST(p.position AS INTEGER) AS position, l.value FROM mart_long l "
        "JOIN places p USING (feature) JOIN muni USING (muni_key) WHERE l.value <> 0")
    q["features_scaled_sparse"] = w(MUNI, MART_LONG, MART, RATES, RATES_LONG) + (
        "SELECT muni_key, CAST(position AS INTEGER) AS position, round(CASE WHEN STDDEV_POP(rate) OVER p > 0 "
        "THEN (rate - AVG(rate) OVER p) / STDDEV_POP(rate) OVER p ELSE 0.0 END, 6) AS z "
        "FROM rates_long WINDOW p AS (PARTITION BY position)")
    n_feat = len(FEATURES)
    q["pca_variance"] = _recursive(*_mart_pca(n_feat)) + (
        "SELECT CAST(component AS INTEGER) AS component, round(ratio, 6) AS ratio, "
        "round(cumulative, 6) AS cumulative, COALESCE(earlier, 0) <= 0.9 AS retained FROM ("
        "SELECT component, ratio, SUM(ratio) OVER (ORDER BY component) AS cumulative, "
        "SUM(ratio) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier "
        "FROM (SELECT component, lam / t AS ratio FROM eig, trace))")
    # the mart keeps one component at the scale of the comparison
    one = [*_mart_pca(1), _pcs(1)]
    q["pca_scores"] = _recursive(*one) + (
        "SELECT r.muni_key, r.muni, r.population, r.state, round(p.pc1, 6) AS pc1 "
        "FROM rates r JOIN pcs p ON p.id = r.muni_key")
    emb_feat = """long AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
feat AS (SELECT id, pos, CASE WHEN STDDEV_POP(v) OVER p > 0 THEN (v - AVG(v) OVER p) / STDDEV_POP(v) OVER p
  ELSE 0.0 END AS v FROM long WINDOW p AS (PARTITION BY pos))"""
    three = [emb_feat, *_pca_ctes(3)]
    q["pca_embeddings"] = _recursive(*three, _pcs(3)) + (
        "SELECT id AS vec_id, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2, round(pc3, 6) AS pc3 FROM pcs")
    q["pca_embeddings_variance"] = _recursive(*three) + (
        "SELECT CAST(component AS INTEGER) AS component, round(lam / t, 9) AS ratio FROM eig, trace")
    mart_pts = [*one, "pts AS MATERIALIZED (SELECT id, [pc1] AS x FROM pcs)"]
    swept = _recursive(*mart_pts, *_kmeans_ctes(list(range(2, 9))), KMEANS_EVAL)
    q["kmeans_evaluation"] = swept + (
        "SELECT CAST(k AS BIGINT) AS k, round(inertia, 6) AS inertia, round(silhouette, 6) AS silhouette FROM kev")
    q["kmeans_metrics"] = swept + (
        "SELECT round((SELECT silhouette FROM kev WHERE k = 4), 6) AS silhouette_final, "
        "CAST(k AS BIGINT) AS best_k, round(silhouette, 6) AS best_silhouette, "
        "round((SELECT lam / t * 100.0 FROM eig, trace), 6) AS retained_pct, CAST(1 AS INTEGER) AS dims "
        "FROM kev ORDER BY kev.silhouette DESC, k LIMIT 1")
    four = _recursive(*mart_pts, *_kmeans_ctes([4]))
    q["kmeans_labels"] = four + (
        "SELECT r.muni_key, r.muni, r.population, CAST(l.label AS BIGINT) AS cluster "
        "FROM rates r JOIN klab l ON l.id = r.muni_key")
    q["kmeans_embeddings"] = _recursive(
        "pts AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
        *_kmeans_ctes([3, 8])) + (
        "SELECT id AS vec_id, CAST(k AS BIGINT) AS k, CAST(label AS BIGINT) AS cluster, "
        "round(sqrt(d), 6) AS distance FROM klab")
    q["dbscan_embeddings"] = _dbscan_sql(
        1.17, 5, "points AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)", None)
    q["kmeans_assignment"] = w(MUNI, MART_LONG, MART) + (
        "SELECT COUNT(*) AS points, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced "
        "FROM mart WHERE population >= 5000")
    named = _recursive(
        *mart_pts, *_kmeans_ctes([4]), RATES_LONG,
        "lab4 AS (SELECT r.*, CAST(l.label AS BIGINT) AS cluster FROM rates r JOIN klab l ON l.id = r.muni_key)",
        "lab4_long AS (SELECT r.*, CAST(l.label AS BIGINT) AS cluster FROM rates_long r "
        "JOIN klab l ON l.id = r.muni_key)", GSTATS, CMEANS, ZS, NAMES, PROFILES)
    q["kmeans_cluster_names"] = named + (
        "SELECT cluster, members, round(mean_population, 6) AS mean_population, specialty, "
        "round(top_z, 6) AS top_z, cluster_name FROM names")
    q["kmeans_profiles"] = named + (
        "SELECT cluster, cluster_name, position, feature, round(mean_rate, 6) AS mean_rate FROM profiles")
    own = _dbscan_sql(2.0, 38, ",\n".join([*one, "points AS (SELECT id AS k, pc1 FROM pcs)"]), ("pc1",))
    kept = _recursive(*_mart_pca(1)) + "SELECT lam / t * 100.0 FROM eig, trace"
    q["dbscan_pipeline"] = (
        "SELECT CAST(COUNT(DISTINCT CASE WHEN label <> -1 THEN label END) AS BIGINT) AS n_clusters, "
        "CAST(COALESCE(SUM(CASE WHEN label = -1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_outliers, "
        "round(SUM(CASE WHEN label = -1 THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2) AS noise_pct, "
        "CAST(2.0 AS DOUBLE) AS eps, CAST(38 AS INTEGER) AS min_samples, CAST(1 AS INTEGER) AS dims, "
        f"round(({kept}), 2) AS retained_pct FROM ({own})")
    q["dbscan_pipeline_outliers"] = w(
        MUNI, MART_LONG, MART, RATES, RATES_LONG, GSTATS,
        f"dbs AS (SELECT r.*, d.label AS cluster FROM rates r JOIN ({own}) d ON d.k = r.muni_key)", OUT_Z) + (
        "SELECT muni_key, muni, population, state, main_anomaly, round(max_z, 6) AS max_z FROM anom")
    db = w(MUNI, MART_LONG, MART, RATES, RATES_LONG, GSTATS, DBS)
    q["dbscan_members"] = db + "SELECT muni_key, muni, population, cluster, cluster = -1 AS is_outlier FROM dbs"
    q["dbscan_metrics"] = db + (
        "SELECT CAST(COUNT(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS n_clusters, "
        "CAST(COALESCE(SUM(CASE WHEN cluster = -1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_outliers, "
        "CASE WHEN COUNT(*) > 0 THEN round(SUM(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2) "
        "ELSE 0.0 END AS noise_pct FROM dbs")
    q["dbscan_summary"] = db + (
        "SELECT cluster, CAST(COUNT(*) AS BIGINT) AS members, round(AVG(population), 6) AS mean_population, "
        "'Agrupación Natural' AS type FROM dbs WHERE cluster <> -1 GROUP BY cluster")
    q["outlier_anomaly"] = w(MUNI, MART_LONG, MART, RATES, RATES_LONG, GSTATS, DBS, OUT_Z) + (
        "SELECT muni_key, muni, population, state, main_anomaly, round(max_z, 6) AS max_z FROM anom")
    q["outlier_list"] = w(MUNI, MART_LONG, MART, RATES, RATES_LONG, GSTATS, DBS, OUT_Z) + (
        "SELECT muni_key, muni, population, main_anomaly FROM anom ORDER BY population DESC, muni_key LIMIT 15")
    q["dbscan_display"] = db + (
        "SELECT muni_key, CASE WHEN cluster = -1 THEN 'Outlier Atípico' ELSE CAST(cluster AS VARCHAR) END "
        "AS cluster_text FROM dbs")
    return q


ORACLE_SQL: dict[str, str] = _sql()
