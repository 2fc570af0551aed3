"""Independent SQL for the registered queries, written for DuckDB over the same test tables.

``CTES`` holds named building blocks in dependency order; ``statement`` prepends the ones a query mentions.
"""

from __future__ import annotations

import re

from agrovane.operators.agents import AGENTS, MESSAGES
from agrovane.operators.names import DEPARTMENT_FALLBACKS, NAME_ALIASES
from agrovane.plans.queries import DIGITS, UNIT_DIGITS
from agrovane.sources.fixtures import FIXTURE_PLACES, FIXTURE_SPELLINGS
from agrovane.sources.schemas import FEATURE_COLUMNS, PREDICTOR_COLUMNS, SEP_COLUMNS, SPC_COLUMNS, SVE_COLUMNS

CTES: dict[str, str] = {}


def statement(sql: str) -> str:
    """The query with the building blocks it needs, transitively, as a WITH clause."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(sql)
    if not needed:
        return sql
    blocks = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {blocks}\n{sql}"


def r(expression: str, alias: str | None = None, digits: int = DIGITS) -> str:
    return f"round({expression}, {digits}) AS {alias or expression.split('.')[-1]}"


def rs(columns: list[str], digits: int = DIGITS) -> str:
    return ", ".join(r(c, c, digits) for c in columns)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


ZONE = "lpad(CAST(n_nationkey AS VARCHAR), 5, '0')"
KEYS = "codigo_municipio, cultivo, periodo"

# --- domain views ----------------------------------------------------------------------------------------------

CTES["fx_stations"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS codigoestacion, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS codigo_municipio,
       n_name AS nombre_municipio, r_name AS nombre_departamento
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_OBSERVATIONS = {
    "precipitacion": ("CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END", "lineitem", "l_suppkey", "l_shipdate"),
    "temperatura": ("l_quantity", "lineitem", "l_suppkey", "l_shipdate"),
    "humedad": ("o_totalprice / 970", "orders", "o_custkey % 10 + 1", "o_orderdate"),
    "presion": ("l_extendedprice / 97", "lineitem", "l_suppkey", "l_shipdate"),
    "tambiente": ("l_quantity / 2", "lineitem", "l_suppkey", "l_shipdate"),
    "viento": ("o_custkey % 97 + 0.5", "orders", "o_custkey % 10 + 1", "o_orderdate"),
}
for _kind, (_value, _table, _station, _day) in _OBSERVATIONS.items():
    CTES[f"obs_{_kind}"] = f"""
SELECT codigo_municipio, nombre_municipio, {_station} AS estacion,
       CAST({_day} AS DATE) AS fecha, CAST(date_trunc('month', {_day}) AS DATE) AS periodo, {_value} AS valor
FROM {_table} JOIN fx_stations ON CAST({_station} AS VARCHAR) = codigoestacion"""
    # Every observation as landed, whether its station is known or not.
    CTES[f"raw_{_kind}"] = f"""
SELECT {_station} AS estacion, CAST({_day} AS DATE) AS fecha, {_value} AS valor FROM {_table}"""

CTES["fx_sales"] = """
SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""

CTES["fx_production"] = """
SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS codigo_municipio, lower(trim(p_brand)) AS cultivo,
       l_quantity AS area_sembrada, l_quantity * (1 - l_discount) AS area_cosechada,
       l_extendedprice / l_quantity / 100 AS rendimiento
FROM fx_sales"""

CTES["fx_prices"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS periodo, avg(o_totalprice) / 97 AS insumos_nivel
FROM orders GROUP BY 1"""

CTES["fx_socio"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS codigo_municipio, upper(n_name) AS nombre_municipio,
       avg(c_acctbal) / 97 AS nbi_total,
       CAST(count(*) FILTER (WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY')) AS DOUBLE) AS poblacion_rural,
       CAST(count(*) AS DOUBLE) AS poblacion_total
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, n_name"""

CTES["fx_socio_share"] = """
SELECT *, round_even(poblacion_rural / nullif(poblacion_total, 0) * 100, 2) AS pct_rural FROM fx_socio"""

CTES["fx_nbi"] = """
SELECT '00' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS codigo_municipio, c_mktsegment AS nom_mun,
       CASE WHEN c_mktsegment <> 'MACHINERY' THEN avg(c_acctbal) / 97 END AS nbi_total, c_nationkey
FROM customer GROUP BY c_nationkey, c_mktsegment"""

CTES["fx_ndvi"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS codigo_municipio, CAST(o_orderdate AS DATE) AS fecha,
       o_totalprice / 500000 AS ndvi, CAST(0.5 AS DOUBLE) AS ndvi_avg, (o_totalprice - 250000) / 500000 AS ndvi_anomalia
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '4-NOT SPECIFIED'"""

# --- climate ---------------------------------------------------------------------------------------------------

CTES["rain_day"] = """
SELECT codigo_municipio, fecha, sum(valor) AS precip_dia FROM obs_precipitacion GROUP BY 1, 2"""

# A dry run is a set of dry rows whose number among the zone's rows minus their number among its dry rows is constant.
CTES["rain_numbered"] = """
SELECT codigo_municipio, fecha, precip_dia, CAST(date_trunc('month', fecha) AS DATE) AS periodo,
       row_number() OVER (PARTITION BY codigo_municipio ORDER BY fecha) AS n,
       row_number() OVER (PARTITION BY codigo_municipio, precip_dia < 1 ORDER BY fecha) AS m
FROM rain_day"""

CTES["rain_runs"] = """
SELECT codigo_municipio, periodo, count(*) AS days FROM rain_numbered WHERE precip_dia < 1
GROUP BY codigo_municipio, periodo, n - m"""

CTES["rain_longest"] = "SELECT codigo_municipio, periodo, max(days) AS longest FROM rain_runs GROUP BY ALL"

CTES["rain_heavy"] = """
SELECT codigo_municipio, periodo, sum((precip_dia > bound)::INT) AS heavy
FROM rain_numbered JOIN (SELECT codigo_municipio, quantile_cont(precip_dia, 0.95) AS bound FROM rain_day GROUP BY ALL) b
     USING (codigo_municipio) GROUP BY ALL"""

CTES["rain_last_seven"] = """
SELECT a.codigo_municipio, a.periodo, a.n, sum(b.precip_dia) AS seven
FROM rain_numbered a JOIN rain_numbered b ON a.codigo_municipio = b.codigo_municipio AND b.n BETWEEN a.n - 6 AND a.n
GROUP BY ALL"""

CTES["rain_month"] = """
SELECT codigo_municipio, periodo, precip_acum_7d, precip_acum_30d, longest AS dias_secos_consecutivos,
       heavy AS dias_lluvia_extrema
FROM (SELECT codigo_municipio, periodo, sum(precip_dia) AS precip_acum_30d FROM rain_numbered GROUP BY ALL)
JOIN (SELECT codigo_municipio, periodo, avg(seven) AS precip_acum_7d FROM rain_last_seven GROUP BY ALL) USING (codigo_municipio, periodo)
JOIN rain_heavy USING (codigo_municipio, periodo) LEFT JOIN rain_longest USING (codigo_municipio, periodo)"""


def _baseline(source: str, value: str, anomaly: str) -> str:
    return f"""
SELECT m.*, m.{value} - h.base AS {anomaly} FROM {source} m
JOIN (SELECT codigo_municipio AS z, month(periodo) AS mes, avg({value}) AS base FROM {source} GROUP BY 1, 2) h
  ON m.codigo_municipio = h.z AND month(m.periodo) = h.mes"""


CTES["rain_full"] = _baseline("rain_month", "precip_acum_30d", "precip_anomalia_30d")
CTES["tmax_month"] = """
SELECT codigo_municipio, periodo, avg(valor) AS tmax_media_7d, count(*) FILTER (WHERE valor > 33.0) AS dias_tmax_critica
FROM obs_temperatura GROUP BY 1, 2"""
CTES["tmax_full"] = _baseline("tmax_month", "tmax_media_7d", "tmax_anomalia_30d")
for _name in ("humedad", "presion"):
    CTES[f"{_name}_month"] = f"""
SELECT codigo_municipio, periodo, avg(valor) AS {_name}_media_30d FROM obs_{_name} GROUP BY 1, 2"""
    CTES[f"{_name}_full"] = _baseline(f"{_name}_month", f"{_name}_media_30d", f"{_name}_anomalia_30d")
CTES["ambient_full"] = """
SELECT codigo_municipio, periodo, avg(valor) AS tambiente_media_30d, min(valor) AS tmin_media_30d
FROM obs_tambiente GROUP BY 1, 2"""
CTES["wind_full"] = """
SELECT codigo_municipio, periodo, avg(valor) AS viento_media_30d FROM obs_viento GROUP BY 1, 2"""
CTES["climate_full"] = """
SELECT * FROM rain_full FULL JOIN tmax_full USING (codigo_municipio, periodo)
FULL JOIN humedad_full USING (codigo_municipio, periodo) FULL JOIN presion_full USING (codigo_municipio, periodo)
FULL JOIN ambient_full USING (codigo_municipio, periodo) FULL JOIN wind_full USING (codigo_municipio, periodo)"""
CTES["ndvi_month"] = """
SELECT codigo_municipio, CAST(date_trunc('month', fecha) AS DATE) AS periodo, avg(ndvi) AS ndvi_media_30d,
       avg(ndvi_anomalia) AS ndvi_anomalia_30d FROM fx_ndvi GROUP BY 1, 2"""

# --- production, prices, master --------------------------------------------------------------------------------

CTES["crop_yield"] = """
SELECT cultivo, codigo_municipio, avg(rendimiento) AS rendimiento_promedio,
       CASE WHEN avg(rendimiento) > 0 THEN stddev_samp(rendimiento) / avg(rendimiento) ELSE 0 END AS rendimiento_cv,
       sum(area_sembrada) AS area_sembrada, sum(area_cosechada) AS area_cosechada
FROM fx_production WHERE rendimiento IS NOT NULL GROUP BY 1, 2"""
CTES["crop_area"] = """
SELECT *, area_sembrada / nullif(sum(area_sembrada) OVER (PARTITION BY cultivo), 0) AS participacion_municipal
FROM crop_yield"""
CTES["crop_full"] = """
SELECT a.*, k % 12 + 1 AS mes_siembra, (k + 5) % 12 + 1 AS mes_cosecha
FROM (SELECT *, CAST(split_part(cultivo, '#', 2) AS INTEGER) AS k FROM crop_area) a"""
CTES["price_full"] = """
SELECT periodo, insumos_nivel,
       CASE WHEN count(*) OVER w >= 6 THEN insumos_nivel - avg(insumos_nivel) OVER w END AS insumos_anomalia_12m,
       insumos_nivel - lag(insumos_nivel, 3) OVER (ORDER BY periodo) AS insumos_delta_3m
FROM fx_prices WINDOW w AS (ORDER BY periodo ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
CTES["master_full"] = f"""
SELECT codigo_municipio, cultivo, periodo, {", ".join(SPC_COLUMNS)},
       area_sembrada, area_cosechada, rendimiento_promedio, rendimiento_cv, participacion_municipal,
       CAST(list_contains(months, month(periodo)) AS INTEGER) AS fase_fenologica,
       insumos_nivel, insumos_anomalia_12m, insumos_delta_3m, nbi_total, poblacion_rural, pct_rural
FROM (SELECT * EXCLUDE (mes_siembra, mes_cosecha), [mes_siembra, mes_cosecha] AS months FROM crop_full)
JOIN (SELECT * FROM climate_full NATURAL LEFT JOIN price_full) USING (codigo_municipio)
LEFT JOIN (SELECT codigo_municipio, nbi_total, poblacion_rural, pct_rural FROM fx_socio_share) USING (codigo_municipio)"""

# --- scores ----------------------------------------------------------------------------------------------------

CTES["bounds_row"] = "SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}_{n}" for c in FEATURE_COLUMNS for n, p in (("lo", 0.01), ("hi", 0.99))
) + " FROM master_full"
CTES["normal_full"] = f"SELECT {KEYS}, " + ", ".join(
    f"CASE WHEN {c}_lo IS NULL OR {c}_hi = {c}_lo THEN 0.0 WHEN {c} IS NULL THEN NULL "
    f"ELSE (least(greatest({c}, {c}_lo), {c}_hi) - {c}_lo) / ({c}_hi - {c}_lo) END AS {c}"
    for c in FEATURE_COLUMNS
) + " FROM master_full, bounds_row"


def _mean(columns: list[str]) -> str:
    return f"list_avg([{', '.join(columns)}])"


CTES["sub_full"] = (
    f"SELECT {KEYS}, {_mean(SPC_COLUMNS)} AS spc, {_mean(SEP_COLUMNS)} AS sep, {_mean(SVE_COLUMNS)} AS sve FROM normal_full"
)
CTES["score_full"] = """
SELECT *, CASE WHEN ira_score < 0.25 THEN 'Bajo' WHEN ira_score < 0.5 THEN 'Medio' WHEN ira_score < 0.75 THEN 'Alto'
               ELSE 'Crítico' END AS ira_nivel
FROM (SELECT *, least(1.0, greatest(0.0, 0.5 * spc + 0.3 * sep + 0.2 * sve)) AS ira_score FROM sub_full)"""

# --- models ----------------------------------------------------------------------------------------------------

CTES["next_full"] = f"""
SELECT *, lead(rendimiento_promedio) OVER (PARTITION BY codigo_municipio, cultivo ORDER BY periodo) AS target
FROM master_full"""
CTES["train_full"] = f"SELECT {KEYS}, target, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in PREDICTOR_COLUMNS
) + " FROM next_full WHERE target IS NOT NULL AND rendimiento_promedio IS NOT NULL"
CTES["guess_full"] = """
SELECT *, target * 0.9 + precip_acum_7d / 1000 + tmin_media_30d / 100 AS prediction FROM train_full"""
CTES["tree_full"] = f"""
SELECT {KEYS}, round_even(prediction, 3) AS rendimiento_predicho,
       round_even(prediction - 1.96 * 0.1 * s, 3) AS rendimiento_ic_inf,
       round_even(prediction + 1.96 * 0.1 * s, 3) AS rendimiento_ic_sup,
       CASE WHEN month(periodo) <> 6 THEN '[{{"var":"area_sembrada","importance":0.5}}]' ELSE '{{broken' END AS importancia_top3
FROM (SELECT *, stddev_pop(prediction) OVER (PARTITION BY cultivo) AS s FROM guess_full)"""
CTES["net_full"] = f"""
SELECT {KEYS}, round_even(prediction, 3) AS rendimiento_nnet, round_even(prediction - 1.96 * s, 3) AS nnet_ic_inf,
       round_even(prediction + 1.96 * s, 3) AS nnet_ic_sup
FROM (SELECT *, stddev_pop(prediction) OVER () AS s FROM guess_full)"""
CTES["raw_full"] = f"SELECT {KEYS}, -(spc + sve) / 2 AS raw FROM sub_full"
CTES["anomaly_full"] = f"""
SELECT {KEYS}, 1 - (raw - lo) / (hi - lo + 1e-9) AS anomaly_score, raw < cut AS is_anomaly
FROM (SELECT *, min(raw) OVER (PARTITION BY cultivo) AS lo, max(raw) OVER (PARTITION BY cultivo) AS hi FROM raw_full),
     (SELECT quantile_cont(raw, 0.05) AS cut FROM raw_full)"""
CTES["result_full"] = """
SELECT s.*, a.anomaly_score, a.is_anomaly, p.rendimiento_predicho, p.rendimiento_ic_inf, p.rendimiento_ic_sup,
       p.importancia_top3, n.rendimiento_nnet, n.nnet_ic_inf, n.nnet_ic_sup
FROM score_full s LEFT JOIN anomaly_full a USING (codigo_municipio, cultivo, periodo)
LEFT JOIN tree_full p USING (codigo_municipio, cultivo, periodo)
LEFT JOIN net_full n USING (codigo_municipio, cultivo, periodo)"""

# --- serving ---------------------------------------------------------------------------------------------------

CTES["zone_dim"] = "SELECT DISTINCT codigo_municipio, nombre_municipio, nombre_departamento FROM fx_stations"
CTES["latest_full"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY codigo_municipio, cultivo ORDER BY periodo DESC) AS rn
                            FROM result_full) WHERE rn = 1"""
CTES["default_full"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY codigo_municipio, cultivo
                               ORDER BY rendimiento_predicho IS NOT NULL DESC, periodo DESC) AS rn
  FROM result_full) WHERE rn = 1"""
CTES["june_full"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY codigo_municipio, cultivo
                               ORDER BY periodo = DATE '1999-06-01' DESC, rendimiento_predicho IS NOT NULL DESC,
                                        periodo DESC) AS rn
  FROM result_full) WHERE rn = 1"""
CTES["ranked_full"] = f"""
SELECT codigo_municipio, cultivo, strftime(periodo, '%Y-%m-%d') AS periodo, ira_score, ira_nivel, anomaly_score,
       rendimiento_predicho, nombre_municipio, nombre_departamento
FROM latest_full LEFT JOIN zone_dim USING (codigo_municipio)"""

# --- forest ----------------------------------------------------------------------------------------------------

CTES["loss_raw"] = """
SELECT n_regionkey + 1 AS adm1, n_nationkey + 1 AS adm2, year(l_shipdate) AS year, l_returnflag = 'A' AS primary_forest,
       sum(l_quantity) AS ha
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE l_linestatus = 'O' GROUP BY 1, 2, 3, 4"""
CTES["loss_units"] = """
SELECT n_regionkey + 1 AS adm1, n_nationkey + 1 AS adm2, n_nationkey,
       upper(r_name[1]) || CASE WHEN r_name = 'MIDDLE EAST' THEN 'iddle East' ELSE lower(r_name[2:]) END AS departamento,
       'Nation-' || n_nationkey AS municipio
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24"""
CTES["loss_named_rows"] = """
SELECT departamento, municipio, n_nationkey, CAST(year AS INTEGER) AS year, sum(ha) AS tc_loss_ha,
       coalesce(sum(ha) FILTER (WHERE primary_forest), 0) AS primary_loss_ha
FROM loss_raw JOIN loss_units USING (adm1, adm2) GROUP BY 1, 2, 3, 4"""
CTES["loss_zone"] = """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS codigo_municipio, year, tc_loss_ha, primary_loss_ha
FROM loss_named_rows WHERE tc_loss_ha > 0"""
CTES["loss_last"] = "SELECT max(year) AS last FROM loss_zone"
CTES["loss_slope"] = """
SELECT codigo_municipio, CASE WHEN count(*) >= 3
       THEN (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) ELSE 0 END AS slope
FROM (SELECT codigo_municipio, CAST(year - last + 4 AS DOUBLE) AS x, sum(tc_loss_ha) AS y FROM loss_zone, loss_last
      WHERE year >= last - 4 GROUP BY 1, 2) GROUP BY 1"""
CTES["loss_full"] = """
SELECT z.codigo_municipio,
       coalesce(sum(tc_loss_ha) FILTER (WHERE year = last), 0) AS deforestacion_2001,
       coalesce(sum(tc_loss_ha) FILTER (WHERE year >= last - 4), 0) AS deforestacion_total_5y,
       coalesce(sum(tc_loss_ha) FILTER (WHERE year >= last - 9), 0) AS deforestacion_total_10y,
       coalesce(sum(primary_loss_ha) FILTER (WHERE year >= last - 4), 0) AS primary_loss_5y,
       avg(tc_loss_ha) AS deforestacion_ha_promedio, count(DISTINCT year) AS n_anos_datos,
       coalesce(max(slope), 0) AS deforestacion_tendencia,
       CASE WHEN coalesce(max(slope), 0) > 50 THEN 'Aumentando' WHEN coalesce(max(slope), 0) > -50 THEN 'Estable'
            ELSE 'Disminuyendo' END AS deforestacion_tendencia_label
FROM loss_last, loss_zone z LEFT JOIN loss_slope s ON z.codigo_municipio = s.codigo_municipio GROUP BY 1"""

# --- names -----------------------------------------------------------------------------------------------------


def _normal(expression: str) -> str:
    folded = f"upper(strip_accents({expression}))"
    return f"trim(regexp_replace(regexp_replace({folded}, '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _initcap(column: str) -> str:
    return f"upper({column}[1]) || lower({column}[2:])"


_BRAND = "split_part(p_brand, '#', 2)"
# Part names are two lower-case words.
_TITLE = "(" + " || ' ' || ".join(_initcap(f"split_part(p_name, ' ', {i})") for i in (1, 2)) + ")"
CTES["place_zone"] = f"""
SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS codigo,
       CASE WHEN p_size = 1 THEN {listing(FIXTURE_PLACES)}[p_partkey % {len(FIXTURE_PLACES)} + 1]
            WHEN p_size = 2 THEN p_name || ' del ' || p_type ELSE p_name || ' ' || {_BRAND} END AS nombre,
       p_type AS departamento
FROM part"""
CTES["place_rows"] = f"""
SELECT {_initcap("p_type")} AS departamento,
       CASE WHEN p_size = 1 THEN {listing(FIXTURE_SPELLINGS)}[p_partkey % {len(FIXTURE_SPELLINGS)} + 1]
            WHEN l_linenumber = 1 THEN {_TITLE} || ' - ' || {_BRAND}
            WHEN l_linenumber = 2 THEN {_BRAND} || ' ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
            WHEN l_linenumber = 3 THEN p_name || ' del'
            WHEN l_linenumber = 4 THEN translate(p_name, 'aeo', 'áéó')
            WHEN l_linenumber = 5 THEN 'Villa ' || p_size
            ELSE p_name || ' ' || {_BRAND} END AS municipio
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["place_dict"] = f"""
SELECT clave, max(codigo) AS codigo, bool_or(bare) AS bare FROM (
  SELECT {_normal("nombre")} AS clave, codigo, true AS bare FROM place_zone
  UNION ALL SELECT {_normal("nombre || ' ' || departamento")}, codigo, false FROM place_zone) GROUP BY 1"""
CTES["place_alias"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({text(k)}, {_normal(text(v))})" for k, v in NAME_ALIASES.items()
) + ") AS t(clave, destino)"
CTES["place_fixed"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({text(k)}, {text(v)})" for k, v in DEPARTMENT_FALLBACKS.items()
) + ") AS t(clave, dep)"
CTES["place_keys"] = f"""
SELECT DISTINCT departamento, municipio, {_normal("municipio")} AS clave,
       {_normal("municipio || ' ' || departamento")} AS con_dep FROM place_rows"""
CTES["place_cand"] = """
SELECT clave AS nombre, list_distinct(string_split(clave, ' ')) AS w FROM place_dict WHERE bare AND clave <> ''"""
CTES["place_words"] = """
SELECT clave, list_distinct(string_split(clave, ' ')) AS w FROM (SELECT DISTINCT clave FROM place_keys WHERE clave <> '')"""
CTES["place_fuzzy"] = """
SELECT k.clave, min(c.nombre) AS nombre FROM place_words k, place_cand c
WHERE len(list_intersect(k.w, c.w)) >= least(len(k.w), len(c.w)) GROUP BY 1"""
CTES["place_match"] = f"""
SELECT departamento, municipio, coalesce(d1.codigo, d2.codigo, d3.codigo, d4.codigo, d5.codigo) AS codigo_municipio,
       CASE WHEN d1.codigo IS NOT NULL THEN 'directo' WHEN d2.codigo IS NOT NULL THEN 'alias'
            WHEN d3.codigo IS NOT NULL THEN 'departamento' WHEN d4.codigo IS NOT NULL THEN 'departamento_fijo'
            WHEN d5.codigo IS NOT NULL THEN 'palabras' END AS via
FROM place_keys k LEFT JOIN place_dict d1 ON k.clave = d1.clave
LEFT JOIN place_alias a ON k.clave = a.clave LEFT JOIN place_dict d2 ON a.destino = d2.clave
LEFT JOIN place_dict d3 ON k.con_dep = d3.clave
LEFT JOIN place_fixed f ON k.clave = f.clave LEFT JOIN place_dict d4 ON {_normal("municipio || ' ' || f.dep")} = d4.clave
LEFT JOIN place_fuzzy z ON k.clave = z.clave LEFT JOIN place_dict d5 ON z.nombre = d5.clave"""

# --- statements ------------------------------------------------------------------------------------------------

_SQL: dict[str, str] = {}

_BLANK = "CASE WHEN l_returnflag = 'R' THEN NULL ELSE {} END"
_SQL["clean_production"] = f"""
SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS codigo_departamento, s_name AS departamento,
       lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS codigo_municipio, s_name AS municipio, lower(p_brand) AS cultivo,
       p_type AS grupo_cultivo, p_type AS subgrupo_cultivo, p_name AS desagregacion,
       CAST(year(l_shipdate) AS VARCHAR) AS a_o, strftime(l_shipdate, '%Y-%m') AS periodo,
       {_BLANK.format("l_quantity")} AS area_sembrada, CAST(l_linenumber AS DOUBLE) AS area_cosechada,
       {_BLANK.format("l_extendedprice")} AS produccion, l_tax AS rendimiento, l_linestatus AS estado_fisico,
       p_name AS nombre_cientifico, l_returnflag AS ciclo
FROM fx_sales"""
_SQL["clean_ndvi"] = f"SELECT codigo_municipio, fecha, {rs(['ndvi', 'ndvi_avg', 'ndvi_anomalia'])} FROM fx_ndvi"
_SQL["clean_passthrough"] = f"""
SELECT codigo_municipio, nombre_municipio, CAST(NULL AS VARCHAR) AS departamento, {r("nbi_total")}, poblacion_rural,
       poblacion_total, pct_rural FROM fx_socio_share"""
_SQL["zone_code"] = f"SELECT codigo_municipio, {r('nbi_total')} FROM fx_nbi WHERE nom_mun <> 'HOUSEHOLD'"
_SQL["rural_share"] = f"""
SELECT codigo_municipio, nombre_municipio, {r("nbi_total")}, poblacion_rural, poblacion_total, pct_rural FROM fx_socio_share"""
_SQL["source_cutoff"] = f"""
SELECT l_suppkey AS codigoestacion, count(*) AS filas, {r("avg(l_quantity)", "media")}
FROM lineitem WHERE l_shipdate >= DATE '2001-12-31' - 730 GROUP BY 1"""
_SQL["newest_readings"] = f"""
SELECT estacion AS codigoestacion, fecha, {r("valor", "valorobservado")} FROM raw_viento
ORDER BY fecha DESC, estacion, valor LIMIT 600"""
_SQL["column_synonyms"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS codigoestacion, round((o_orderkey % 1000) / 10, 5) AS latitud,
       round(o_totalprice / 5000, 5) AS longitud
FROM orders WHERE o_orderstatus <> 'P'"""
_SQL["footer_rows"] = f"""
SELECT nom_mun, CASE WHEN nom_mun <> 'HOUSEHOLD' THEN ' ' || c_nationkey END AS cod_mun, {r("nbi_total", "valor")}, regla
FROM fx_nbi, (VALUES ('todas'), ('alguna')) AS t(regla)
WHERE CASE WHEN regla = 'todas' THEN nom_mun <> 'HOUSEHOLD' OR nbi_total IS NOT NULL
           ELSE nom_mun <> 'HOUSEHOLD' AND nbi_total IS NOT NULL END"""
_SQL["dedup_by_key"] = """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem)
WHERE rn = 1"""
_SQL["landing_profile"] = " UNION ALL ".join(
    f"SELECT '{k}' AS fuente, count(*) AS filas, min(fecha) AS desde, max(fecha) AS hasta FROM raw_{k}" for k in _OBSERVATIONS
)
_SQL["name_normalize"] = "SELECT DISTINCT municipio, clave FROM place_keys"
_SQL["name_match_cascade"] = "SELECT * FROM place_match"
_SQL["name_match_fuzzy"] = "SELECT clave, nombre FROM place_fuzzy"
_SQL["name_match_report"] = """
SELECT count(*) FILTER (WHERE via IS NOT NULL) AS coincidencias, count(*) AS total,
       count(DISTINCT CASE WHEN via IS NULL THEN municipio END) AS nombres_sin_codigo
FROM place_rows JOIN place_match USING (departamento, municipio)"""
_SQL["station_attach"] = f"""
SELECT codigo_municipio, nombre_municipio, count(*) AS filas, {r("sum(valor)", "suma")} FROM obs_precipitacion GROUP BY 1, 2"""
_SQL["station_zone_spatial"] = """
WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS codigoestacion, round((o_orderkey % 1000) / 10, 5) AS latitud,
                  round(o_totalprice / 5000, 5) AS longitud
           FROM orders WHERE o_orderstatus <> 'P'),
z AS (SELECT n_nationkey % 5 * 20 AS x0, n_nationkey // 5 * 20 AS y0, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS codigo_municipio,
             n_name AS nombre_municipio, lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS codigo_departamento,
             r_name AS nombre_departamento
      FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT codigoestacion, latitud, longitud, codigo_municipio, nombre_municipio, codigo_departamento, nombre_departamento
FROM p LEFT JOIN z ON longitud > x0 AND longitud < x0 + 20 AND latitud > y0 AND latitud < y0 + 20
  AND NOT (longitud >= x0 + 9 AND longitud <= x0 + 11 AND latitud >= y0 + 9 AND latitud <= y0 + 11)"""
_SQL["rain_daily"] = f"SELECT codigo_municipio, fecha, {rs(['precip_dia'])} FROM rain_day"
_SQL["rain_rolling7"] = f"""SELECT codigo_municipio, fecha, {r('precip_dia')}, {r('seven', 'precip_7d')}
FROM rain_numbered JOIN rain_last_seven USING (codigo_municipio, periodo, n)"""
_SQL["rain_p95_days"] = f"""
SELECT codigo_municipio, {r("quantile_cont(precip_dia, 0.95)", "umbral")}, max(n) AS dias_lluvia_extrema
FROM rain_day JOIN (SELECT codigo_municipio, sum(heavy) AS n FROM rain_heavy GROUP BY 1) USING (codigo_municipio) GROUP BY 1"""
_SQL["dry_streak"] = "SELECT codigo_municipio, periodo, longest AS dias_secos_consecutivos FROM rain_longest"
_SQL["rain_monthly"] = f"""
SELECT codigo_municipio, periodo, dias_secos_consecutivos, dias_lluvia_extrema,
       {rs(['precip_acum_7d', 'precip_acum_30d', 'precip_anomalia_30d'])} FROM rain_full"""
_SQL["tmax_monthly"] = f"""
SELECT codigo_municipio, periodo, dias_tmax_critica, {rs(['tmax_media_7d', 'tmax_anomalia_30d'])} FROM tmax_full"""
_SQL["humidity_monthly"] = f"""
SELECT codigo_municipio, periodo, {rs(['humedad_media_30d', 'humedad_anomalia_30d'])} FROM humedad_full"""
_SQL["pressure_monthly"] = f"""
SELECT codigo_municipio, periodo, {rs(['presion_media_30d', 'presion_anomalia_30d'])} FROM presion_full"""
_SQL["ambient_monthly"] = f"""
SELECT codigo_municipio, periodo, {rs(['tambiente_media_30d', 'tmin_media_30d'])} FROM ambient_full"""
_SQL["wind_monthly"] = f"SELECT codigo_municipio, periodo, {rs(['viento_media_30d'])} FROM wind_full"
_COUNTS = ["dias_secos_consecutivos", "dias_lluvia_extrema", "dias_tmax_critica"]
_SQL["climate_outer"] = f"""
SELECT codigo_municipio, periodo, {", ".join(_COUNTS)}, {rs([c for c in SPC_COLUMNS if c not in _COUNTS])} FROM climate_full"""
_SQL["ndvi_monthly"] = f"""
SELECT codigo_municipio, periodo, {rs(['ndvi_media_30d', 'ndvi_anomalia_30d'])} FROM ndvi_month"""
_YIELD = ["rendimiento_promedio", "rendimiento_cv", "area_sembrada", "area_cosechada"]
_SQL["yield_stats"] = f"SELECT cultivo, codigo_municipio, {rs(_YIELD)} FROM crop_yield"
_SQL["crop_share"] = f"SELECT cultivo, codigo_municipio, {rs([*_YIELD, 'participacion_municipal'])} FROM crop_area"
_SQL["crop_calendar"] = f"""
SELECT cultivo, codigo_municipio, {rs(_YIELD)}, k % 12 + 1 AS mes_siembra,
       (k + CAST(codigo_municipio AS INTEGER)) % 12 + 1 AS mes_cosecha
FROM (SELECT *, CAST(split_part(cultivo, '#', 2) AS INTEGER) AS k FROM crop_yield)"""
_SQL["price_features"] = f"""
SELECT periodo, {rs(['insumos_nivel', 'insumos_anomalia_12m', 'insumos_delta_3m'])} FROM price_full"""
_SQL["socio_features"] = f"""
SELECT codigo_municipio, {r("nbi_total")}, CAST(NULL AS DOUBLE) AS poblacion_rural, CAST(NULL AS DOUBLE) AS pct_rural
FROM fx_nbi WHERE nom_mun <> 'HOUSEHOLD'"""
_SQL["loss_by_year"] = """
SELECT 'COL' AS iso, CAST(adm1 AS VARCHAR) AS adm1, CAST(adm2 AS VARCHAR) AS adm2, CAST(year AS VARCHAR) AS year,
       round(sum(ha), 5) AS ha, primaria
FROM loss_raw, (VALUES (true), (false)) AS t(primaria) WHERE primary_forest OR NOT primaria GROUP BY 1, 2, 3, 4, 6"""
_SQL["loss_named"] = f"""
SELECT coalesce(departamento, '(sin nombre)') AS departamento, coalesce(municipio, '(sin nombre)') AS municipio,
       count(*) AS filas, {r("sum(ha)", "ha")}
FROM (SELECT adm1, adm2, year, sum(ha) AS ha FROM loss_raw GROUP BY 1, 2, 3) LEFT JOIN loss_units USING (adm1, adm2)
GROUP BY 1, 2"""
_SQL["loss_pivot"] = "SELECT 'Colombia' AS country, departamento AS subnational1, municipio AS subnational2, 30 AS threshold, " + ", ".join(
    f"round(sum(tc_loss_ha) FILTER (WHERE year = {y}), 5) AS tc_loss_ha_{y}" for y in range(1995, 2002)
) + " FROM loss_named_rows GROUP BY departamento, municipio"
_SQL["loss_unpivot"] = f"""
SELECT departamento, municipio, year, {rs(['tc_loss_ha'])} FROM loss_named_rows WHERE year >= 1996 AND tc_loss_ha > 0"""
_SQL["loss_primary"] = f"""
SELECT departamento, municipio, year, {rs(['tc_loss_ha', 'primary_loss_ha'])} FROM loss_named_rows WHERE tc_loss_ha > 0"""
_LOSS = [
    "deforestacion_2001",
    "deforestacion_total_5y",
    "deforestacion_total_10y",
    "primary_loss_5y",
    "deforestacion_ha_promedio",
    "deforestacion_tendencia",
]
_SQL["loss_features"] = f"""
SELECT codigo_municipio, n_anos_datos, deforestacion_tendencia_label, {rs(_LOSS)} FROM loss_full"""
_SQL["loss_trend"] = f"""
SELECT deforestacion_tendencia_label, count(*) AS zonas, {r("avg(deforestacion_tendencia)", "pendiente_media")}
FROM loss_full GROUP BY 1"""
_MASTER_INTS = [*_COUNTS, "fase_fenologica"]
_SQL["master_features"] = f"""
SELECT {KEYS}, {", ".join(_MASTER_INTS)}, {rs([c for c in FEATURE_COLUMNS if c not in _MASTER_INTS])} FROM master_full"""
_SQL["normalize_bounds"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round({c}_lo, {DIGITS}) AS p1, round({c}_hi, {DIGITS}) AS p99 FROM bounds_row" for c in FEATURE_COLUMNS
)
_SQL["normalized_features"] = f"SELECT {KEYS}, {rs(FEATURE_COLUMNS, UNIT_DIGITS)} FROM normal_full"
_SQL["subindices"] = f"SELECT {KEYS}, {rs(['spc', 'sep', 'sve'], UNIT_DIGITS)} FROM sub_full"
_SQL["risk_scores"] = f"SELECT {KEYS}, ira_nivel, {rs(['spc', 'sep', 'sve', 'ira_score'], UNIT_DIGITS)} FROM score_full"
_SQL["level_distribution"] = "SELECT ira_nivel, count(*) AS filas FROM score_full GROUP BY 1"
_SQL["next_target"] = f"""
SELECT {KEYS}, {r("area_sembrada")}, {r("coalesce(humedad_media_30d, 0)", "humedad_media_30d")}, {r("target")}
FROM (SELECT *, lead(y) OVER (PARTITION BY codigo_municipio, cultivo ORDER BY periodo) AS target
      FROM (SELECT *, rendimiento_promedio + precip_acum_7d / 100 AS y FROM master_full))
WHERE target IS NOT NULL AND y IS NOT NULL"""
_SQL["standardized"] = f"SELECT {KEYS}, " + ", ".join(
    # + 0e0: a negative zero becomes a zero.
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 4) + 0e0 AS {c}" for c in PREDICTOR_COLUMNS
) + " FROM train_full"
_SQL["cv_folds"] = f"""
SELECT {KEYS}, alcance, CAST(CASE WHEN i < e * (q + 1) THEN i // (q + 1) ELSE e + (i - e * (q + 1)) // q END AS INTEGER) AS fold
FROM (SELECT *, n // 5 AS q, n % 5 AS e FROM (
  SELECT {KEYS}, 'cultivo' AS alcance, row_number() OVER (PARTITION BY cultivo ORDER BY codigo_municipio, periodo) - 1 AS i,
         count(*) OVER (PARTITION BY cultivo) AS n FROM train_full
  UNION ALL SELECT {KEYS}, 'global', row_number() OVER (ORDER BY codigo_municipio, cultivo, periodo) - 1, count(*) OVER ()
  FROM train_full))"""
CTES["hold_cut"] = """
SELECT periodo AS corte FROM (SELECT periodo, row_number() OVER (ORDER BY periodo DESC) AS k, count(*) OVER () AS n
                              FROM (SELECT DISTINCT periodo FROM train_full))
WHERE k = greatest(1, CAST(round_even(n * 0.2, 0) AS INTEGER))"""
_SQL["temporal_split"] = """
SELECT CASE WHEN periodo < corte THEN 'train' ELSE 'test' END AS lado, count(*) AS filas, min(periodo) AS desde,
       max(periodo) AS hasta, corte AS periodo_corte FROM train_full, hold_cut GROUP BY 1, corte"""
_SQL["model_metrics"] = """
SELECT coalesce(cultivo, 'todos') AS modelo,
       round_even(1 - sum((target - prediction) ** 2) / nullif(var_pop(target) * count(*), 0), 4) AS r2,
       round_even(avg(abs(target - prediction)), 4) AS mae, round_even(sqrt(avg((target - prediction) ** 2)), 4) AS rmse,
       count(*) AS n_test
FROM guess_full GROUP BY GROUPING SETS ((), (cultivo))"""
_SQL["yield_interval"] = "SELECT * EXCLUDE (importancia_top3) FROM tree_full"
_SQL["network_interval"] = "SELECT * FROM net_full"
_SQL["anomaly_rescale"] = f"SELECT {KEYS}, {rs(['anomaly_score'])}, is_anomaly FROM anomaly_full"
_RESULT_DOUBLES = [
    "spc",
    "sep",
    "sve",
    "ira_score",
    "anomaly_score",
    "rendimiento_predicho",
    "rendimiento_ic_inf",
    "rendimiento_ic_sup",
    "rendimiento_nnet",
    "nnet_ic_inf",
    "nnet_ic_sup",
]
_SQL["result_assembly"] = f"""
SELECT {KEYS}, ira_nivel, is_anomaly, importancia_top3, {rs(_RESULT_DOUBLES)} FROM result_full"""
_SQL["filters"] = """
SELECT 'cultivo' AS lista, cultivo AS valor FROM (SELECT DISTINCT cultivo FROM result_full)
UNION ALL SELECT 'departamento', nombre_departamento FROM (SELECT DISTINCT nombre_departamento FROM fx_stations)"""
_RANKED = f"""codigo_municipio, cultivo, periodo, ira_nivel, nombre_municipio, nombre_departamento,
       {rs(['ira_score', 'anomaly_score', 'rendimiento_predicho'])}"""
_SQL["ranking"] = f"""
SELECT {_RANKED} FROM (SELECT * FROM ranked_full ORDER BY ira_score DESC NULLS LAST, codigo_municipio, cultivo LIMIT 50)"""
_SQL["ranking_page"] = f"""
SELECT {_RANKED} FROM (SELECT * FROM ranked_full WHERE nombre_departamento = 'ASIA'
  ORDER BY ira_score ASC NULLS LAST, codigo_municipio, cultivo LIMIT 20 OFFSET 20)"""
_SQL["ranking_search"] = " UNION ALL ".join(
    f"""SELECT {_RANKED} FROM (SELECT * FROM ranked_full
  WHERE nombre_municipio ILIKE '{q}' OR nombre_departamento ILIKE '{q}' OR cultivo ILIKE '{q}'
)"""
    for q in ("%nd#1%", "%nation_2%")
)
_SQL["ranking_total"] = "SELECT count(*) AS total FROM ranked_full WHERE cultivo = 'brand#7'"
_SQL["map_layer"] = f"""
SELECT codigo_municipio, n_name AS municipio, r_name AS departamento, {r("ira_score")}, ira_nivel, cultivo,
       strftime(periodo, '%Y-%m-%d') AS periodo
FROM (SELECT *, row_number() OVER (PARTITION BY codigo_municipio ORDER BY ira_score DESC NULLS LAST, cultivo) AS k FROM latest_full)
JOIN nation ON codigo_municipio = {ZONE} JOIN region ON n_regionkey = r_regionkey WHERE k = 1"""
_SQL["zone_history"] = f"""
SELECT codigo_municipio, cultivo, strftime(periodo, '%Y-%m-%d') AS periodo, ira_nivel, nombre_municipio,
       {rs(['ira_score', 'anomaly_score', 'rendimiento_predicho'])}
FROM result_full LEFT JOIN zone_dim USING (codigo_municipio),
     (SELECT codigo_municipio AS z, cultivo AS c, strftime(periodo, '%Y') AS y FROM result_full
      WHERE codigo_municipio IS NOT NULL AND cultivo IS NOT NULL AND periodo IS NOT NULL
      ORDER BY codigo_municipio, cultivo, periodo LIMIT 1) AS pick
WHERE codigo_municipio = z AND cultivo = c AND CAST(periodo AS VARCHAR) LIKE y || '%'"""
_SQL["crop_history"] = f"""
SELECT {KEYS}, {rs(['ira_score', 'rendimiento_predicho'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY codigo_municipio, cultivo ORDER BY periodo DESC) AS k FROM result_full) WHERE k <= 24"""
_SQL["latest_per_crop"] = f"""
SELECT codigo_municipio, cultivo, strftime(periodo, '%Y-%m-%d') AS periodo, ira_nivel,
       {rs(['ira_score', 'spc', 'sep', 'sve', 'rendimiento_predicho', 'anomaly_score'])} FROM latest_full"""
_SQL["default_period"] = f"SELECT {KEYS}, {rs(['ira_score', 'rendimiento_predicho'])} FROM default_full"
_SQL["general_summary"] = """
SELECT codigo_municipio, nombre_municipio, nombre_departamento, total_cultivos, ira_promedio, bajo, medio, alto, critico,
       array_to_string(l[1:3], ',') AS mayor_riesgo, array_to_string(list_reverse(l)[1:3], ',') AS menor_riesgo
FROM (SELECT codigo_municipio, count(*) AS total_cultivos, round_even(avg(ira_score), 4) AS ira_promedio,
             CAST(count(*) FILTER (WHERE ira_nivel = 'Bajo') AS INTEGER) AS bajo,
             CAST(count(*) FILTER (WHERE ira_nivel = 'Medio') AS INTEGER) AS medio,
             CAST(count(*) FILTER (WHERE ira_nivel = 'Alto') AS INTEGER) AS alto,
             CAST(count(*) FILTER (WHERE ira_nivel = 'Crítico') AS INTEGER) AS critico,
             list(cultivo ORDER BY coalesce(ira_score, 0) DESC, cultivo) AS l
      FROM latest_full GROUP BY 1) LEFT JOIN zone_dim USING (codigo_municipio)"""
_SQL["report_summary"] = f"""
SELECT codigo_municipio, total_cultivos, {rs(['ira_promedio', 'spc_promedio', 'sep_promedio', 'sve_promedio', 'rendimiento_promedio'])},
       coalesce(n, 0) AS cultivos_con_rendimiento, l[1] AS mayor, l[len(l)] AS menor
FROM (SELECT codigo_municipio, count(*) AS total_cultivos, avg(ira_score) AS ira_promedio, avg(spc) AS spc_promedio,
             avg(sep) AS sep_promedio, avg(sve) AS sve_promedio,
             list(cultivo ORDER BY coalesce(ira_score, 0) DESC, cultivo) AS l FROM latest_full GROUP BY 1)
LEFT JOIN (SELECT codigo_municipio, avg(y) AS rendimiento_promedio, count(*) AS n FROM (
   SELECT codigo_municipio, coalesce(rendimiento_predicho, rendimiento_nnet) AS y,
          row_number() OVER (PARTITION BY codigo_municipio, cultivo ORDER BY periodo DESC) AS k
   FROM result_full WHERE coalesce(rendimiento_predicho, rendimiento_nnet) IS NOT NULL) WHERE k = 1 GROUP BY 1)
USING (codigo_municipio)"""
_SQL["crop_context"] = f"""
SELECT codigo_municipio, cultivo, periodo AS periodo_seleccionado, {r("ira_score")},
       {rs(['rendimiento_ic_inf', 'rendimiento_ic_sup', 'rendimiento_nnet'])}, is_anomaly,
       CASE WHEN month(periodo) <> 6 AND importancia_top3 IS NOT NULL THEN 'area_sembrada' END AS principal,
       historial, mas_reciente, nombre_municipio
FROM june_full JOIN (SELECT codigo_municipio, cultivo, CAST(least(count(*), 24) AS INTEGER) AS historial,
                            strftime(max(periodo), '%Y-%m-%d') AS mas_reciente FROM result_full GROUP BY 1, 2)
USING (codigo_municipio, cultivo) LEFT JOIN zone_dim USING (codigo_municipio)"""
_SQL["parsed_drivers"] = """
SELECT cultivo, count(importancia_top3) AS guardados, count(*) FILTER (WHERE json_valid(importancia_top3)) AS leidos,
       max(CASE WHEN json_valid(importancia_top3) THEN 0.5 END)::DOUBLE AS importancia FROM result_full GROUP BY 1"""
_SQL["dominant_component"] = f"""
SELECT {KEYS}, CASE WHEN spc >= coalesce(sep, -1) AND spc >= coalesce(sve, -1) THEN 'spc'
                    WHEN sep >= coalesce(sve, -1) THEN 'sep' ELSE 'sve' END AS componente,
       {r("greatest(spc, sep, sve)", "valor_componente")} FROM latest_full"""


def _level(column: str) -> str:
    return f"CASE WHEN {column} > 0.75 THEN 'crítico' WHEN {column} > 0.5 THEN 'alto' WHEN {column} > 0.25 THEN 'medio' ELSE 'bajo' END"


def _by_level(level: str, texts: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {listing(v)}" for k, v in texts.items())
    return f"CASE {level} {cases} ELSE CAST([] AS VARCHAR[]) END"


_LEVELS = ", ".join(f"{_level(a[1])} AS nivel_{a[1]}" for a in AGENTS)
_FOUND = ", ".join(f"{_by_level(f'nivel_{a[1]}', a[3])} AS h_{a[1]}" for a in AGENTS)
_ADVICE = " || ".join(f"({_by_level(f'nivel_{a[1]}', a[4])})" for a in AGENTS)


def _agent_sql(source: str) -> str:
    return f"""
SELECT codigo_municipio, cultivo, periodo, nivel_spc, nivel_sep, nivel_sve, CAST(len(h_spc) AS INTEGER) AS hallazgos_spc,
       CAST(len(t) AS INTEGER) AS hallazgos_sep, CAST(len(h_sve) AS INTEGER) AS hallazgos_sve,
       array_to_string(t, '; ') AS texto_sep
FROM (SELECT *, list_transform(h_sep, lambda x: replace(x, '{{cultivo}}', cultivo))
        || CASE WHEN rendimiento_predicho < 5 THEN ['Rendimiento esperado bajo'] ELSE CAST([] AS VARCHAR[]) END AS t
      FROM (SELECT *, {_FOUND} FROM (SELECT *, {_LEVELS} FROM {source})))"""


_SQL["agent_levels"] = _agent_sql("default_full")
CTES["mean_full"] = """
SELECT codigo_municipio, 'los cultivos del municipio' AS cultivo, max(periodo) AS periodo, avg(spc) AS spc, avg(sep) AS sep,
       avg(sve) AS sve, avg(rendimiento_predicho) AS rendimiento_predicho FROM latest_full GROUP BY 1"""
_SQL["agent_general"] = _agent_sql("mean_full")
_SQL["agent_coordinator"] = f"""
SELECT codigo_municipio, cultivo, periodo, prioridad, CASE prioridad {" ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in MESSAGES.items())} END AS resumen,
       array_to_string(recs[1:5], '; ') AS recomendaciones
FROM (SELECT *, CASE WHEN 'crítico' IN (nivel_spc, nivel_sep, nivel_sve) THEN 'crítico'
                     WHEN 'alto' IN (nivel_spc, nivel_sep, nivel_sve) THEN 'alto'
                     WHEN 'medio' IN (nivel_spc, nivel_sep, nivel_sve) THEN 'medio' ELSE 'bajo' END AS prioridad,
             {_ADVICE} AS recs
      FROM (SELECT *, {_LEVELS} FROM june_full))"""
_SQL["ndvi_series"] = f"""
SELECT codigo_municipio, strftime(periodo, '%Y-%m-%d') AS periodo, {r("ndvi_media_30d", "ndvi")}, {r("ndvi_anomalia_30d", "anomalia")}
FROM ndvi_month"""
_SQL["loss_digest"] = f"""
SELECT codigo_municipio, 'deforestacion_2001' AS ultimo_anio_columna, {r("deforestacion_2001", "ultimo_anio_ha")},
       {r("deforestacion_total_5y", "total_5_anios_ha")}, {r("deforestacion_total_10y", "total_10_anios_ha")},
       deforestacion_tendencia_label AS tendencia FROM loss_full"""
_SQL["stream_landing"] = f"""
SELECT CAST(user_id % 10 AS VARCHAR) AS codigoestacion, count(*) AS lecturas, {r("sum(value)", "suma")}
FROM (SELECT DISTINCT ON (user_id % 10, ts) * FROM events) GROUP BY 1"""
_SQL["stream_daily"] = f"""
SELECT codigo_municipio, CAST(ts AS DATE) AS fecha, {r("sum(value)", "precip_dia")}
FROM events JOIN fx_stations ON CAST(user_id % 10 AS VARCHAR) = codigoestacion
GROUP BY 1, 2"""
_SQL["stream_refresh"] = f"""
SELECT codigo_municipio, CAST(date_trunc('month', ts) AS DATE) AS periodo, {r("avg(value)", "viento_media_30d")}
FROM events JOIN fx_stations ON CAST(user_id % 10 AS VARCHAR) = codigoestacion GROUP BY 1, 2"""

ORACLES = {name: statement(sql) for name, sql in _SQL.items()}
