"""Typed schemas of the landed and derived tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    """Build a schema from a ``name type, …`` list."""
    kinds = {
        "string": T.StringType(),
        "double": T.DoubleType(),
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "date": T.DateType(),
        "timestamp": T.TimestampType(),
        "boolean": T.BooleanType(),
    }
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


OBSERVATION = _struct("codigoestacion string, fechaobservacion timestamp, valorobservado double")
OBSERVATION_TEXT = _struct("codigoestacion string, fechaobservacion string, valorobservado string")

PRODUCTION_RAW = _struct(
    "c_d_dep string, departamento string, c_d_mun string, municipio string, cultivo string, "
    "grupo_de_cultivo string, subgrupo_de_cultivo string, desagregaci_n_regional_y string, a_o string, "
    "periodo string, rea_sembrada_ha string, rea_cosechada_ha string, producci_n_t string, "
    "rendimiento_t_ha string, estado_fisico_produccion string, nombre_cientifico string, ciclo_de_cultivo string"
)
NDVI_RAW = _struct("PCODE string, date string, adm_level int, vim double, vim_avg double, viq double")
LOSS_LONG = _struct("iso string, adm1 int, adm2 int, year int, ha double")
ADM_NAMES = _struct("gid_2 string, name_1 string, name_2 string")
SOCIO = _struct(
    "codigo_municipio string, nombre_municipio string, departamento string, nbi_total double, "
    "poblacion_rural double, poblacion_total double, pct_rural double"
)

# The 13 landed tables. A missing one reads as an empty frame with this schema.
RAW_TABLES: dict[str, T.StructType] = {
    "raw_estaciones": _struct("codigoestacion string, latitud string, longitud string"),
    "raw_eva": PRODUCTION_RAW,
    "raw_eva_calendario": _struct("cultivo string, codigo_municipio string, mes_siembra int, mes_cosecha int"),
    "raw_insumos": _struct("periodo string, nivel string"),
    "raw_precipitacion": OBSERVATION,
    "raw_temperatura": OBSERVATION,
    "raw_humedad": OBSERVATION,
    "raw_presion": OBSERVATION,
    "raw_tambiente": OBSERVATION,
    "raw_dane_municipios": SOCIO,
    "raw_dane_nbi": _struct("codigo_municipio string, nbi_total double"),
    "raw_viento": OBSERVATION,
    "raw_ndvi": NDVI_RAW,
}

STATIONS = _struct(
    "codigoestacion string, latitud double, longitud double, codigo_municipio string, nombre_municipio string, "
    "codigo_departamento string, nombre_departamento string"
)

KEY = ["codigo_municipio", "cultivo", "periodo"]

# The feature groups of the three sub-indices.
SPC_COLUMNS = [
    "precip_acum_7d",
    "precip_acum_30d",
    "precip_anomalia_30d",
    "dias_secos_consecutivos",
    "dias_lluvia_extrema",
    "tmax_media_7d",
    "tmax_anomalia_30d",
    "dias_tmax_critica",
    "humedad_media_30d",
    "humedad_anomalia_30d",
    "presion_media_30d",
    "presion_anomalia_30d",
    "tambiente_media_30d",
    "tmin_media_30d",
    "viento_media_30d",
]
SEP_COLUMNS = [
    "area_sembrada",
    "area_cosechada",
    "rendimiento_promedio",
    "rendimiento_cv",
    "participacion_municipal",
    "fase_fenologica",
]
SVE_COLUMNS = [
    "insumos_nivel",
    "insumos_anomalia_12m",
    "insumos_delta_3m",
    "nbi_total",
    "poblacion_rural",
    "pct_rural",
]
FEATURE_COLUMNS = SPC_COLUMNS + SEP_COLUMNS + SVE_COLUMNS

# The 23 yield predictors (no wind, no yield-derived columns, no rural head count).
PREDICTOR_COLUMNS = [
    "precip_acum_7d",
    "precip_acum_30d",
    "precip_anomalia_30d",
    "dias_secos_consecutivos",
    "dias_lluvia_extrema",
    "tmax_media_7d",
    "tmax_anomalia_30d",
    "dias_tmax_critica",
    "humedad_media_30d",
    "humedad_anomalia_30d",
    "presion_media_30d",
    "presion_anomalia_30d",
    "tambiente_media_30d",
    "tmin_media_30d",
    "area_sembrada",
    "area_cosechada",
    "participacion_municipal",
    "fase_fenologica",
    "insumos_nivel",
    "insumos_anomalia_12m",
    "insumos_delta_3m",
    "nbi_total",
    "pct_rural",
]
