"""Rule-based findings and recommendations per sub-index, and their synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels in rising order and their strict lower thresholds.
ORDER = ["bajo", "medio", "alto", "crítico"]
THRESHOLDS = [("crítico", 0.75), ("alto", 0.50), ("medio", 0.25)]
LOW_YIELD = 5
LOW_YIELD_FINDING = "Rendimiento esperado bajo"

# Fixed values: (agent, field, description, findings by level, recommendations by level).
AGENTS = [
    (
        "Clima",
        "spc",
        "Analiza el peligro climático (SPC) y sus componentes",
        {
            "crítico": [
                "Precipitación extrema o sequía prolongada",
                "Temperaturas fuera del rango óptimo para cultivos",
            ],
            "alto": ["Condiciones climáticas adversas significativas"],
            "medio": ["Variabilidad climática moderada"],
        },
        {
            "crítico": [
                "Implementar sistemas de riego y drenaje",
                "Usar coberturas vegetales para proteger el suelo",
                "Monitorear pronósticos climáticos semanalmente",
            ],
            "alto": [
                "Implementar sistemas de riego y drenaje",
                "Usar coberturas vegetales para proteger el suelo",
                "Monitorear pronósticos climáticos semanalmente",
            ],
            "medio": ["Mantener calendario de monitoreo climático"],
        },
    ),
    (
        "Producción",
        "sep",
        "Analiza la exposición productiva (SEP) del municipio",
        {
            "crítico": ["Alta dependencia productiva en {cultivo}", "Baja diversificación agrícola"],
            "alto": ["Exposición significativa en {cultivo}"],
            "medio": ["Dependencia moderada en {cultivo}"],
        },
        {
            "crítico": [
                "Diversificar cultivos para reducir riesgo",
                "Explorar mercados alternativos",
                "Fortalecer cadenas de valor locales",
            ],
            "alto": [
                "Diversificar cultivos para reducir riesgo",
                "Explorar mercados alternativos",
                "Fortalecer cadenas de valor locales",
            ],
            "medio": ["Evaluar rotación de cultivos"],
        },
    ),
    (
        "Vulnerabilidad",
        "sve",
        "Analiza la vulnerabilidad socioeconómica (SVE)",
        {
            "crítico": ["Alto índice de necesidades básicas insatisfechas", "Población rural vulnerable"],
            "alto": ["Vulnerabilidad económica significativa"],
            "medio": ["Vulnerabilidad económica moderada"],
        },
        {
            "crítico": [
                "Gestionar subsidios y apoyos directos a productores",
                "Fortalecer programas de asistencia técnica rural",
                "Promover asociaciones de productores",
            ],
            "alto": [
                "Gestionar subsidios y apoyos directos a productores",
                "Fortalecer programas de asistencia técnica rural",
                "Promover asociaciones de productores",
            ],
            "medio": ["Mantener programas de capacitación agrícola"],
        },
    ),
]
# Message of the coordinator by highest level.
MESSAGES = {
    "crítico": "Se requiere acción inmediata. Todos los indicadores de riesgo están elevados.",
    "alto": "Se recomienda intervención prioritaria. Varios factores de riesgo requieren atención.",
    "medio": "Monitoreo regular recomendado. Algunos indicadores requieren seguimiento.",
    "bajo": "Condiciones favorables. Mantener monitoreo de rutina.",
}
MAX_RECOMMENDATIONS = 5


def agent_level(value: Column) -> Column:
    """Level by strict thresholds; NULL is the lowest."""
    out = None
    for name, bound in THRESHOLDS:
        out = F.when(value > bound, name) if out is None else out.when(value > bound, name)
    return out.otherwise(ORDER[0])


def _texts(level: Column, by_level: dict[str, list[str]]) -> Column:
    """The texts of a level as an array; none for a level without texts."""
    empty = F.array().cast("array<string>")
    out = None
    for name, texts in by_level.items():
        value = F.array(*map(F.lit, texts))
        out = F.when(level == name, value) if out is None else out.when(level == name, value)
    return out.otherwise(empty)


def analyze(rows: DataFrame) -> DataFrame:
    """Adds ``agentes`` (one struct per sub-index) and the coordinator's priority, message and recommendations.

    Needs ``cultivo, spc, sep, sve, rendimiento_predicho``; everything is one projection.
    """
    crop = F.coalesce("cultivo", F.lit("desconocido"))
    agents, levels = [], []
    for name, field, description, findings, recommendations in AGENTS:
        value = F.col(field)
        level = agent_level(value)
        levels.append(level)
        found = F.transform(_texts(level, findings), lambda t: F.replace(t, F.lit("{cultivo}"), crop))
        if field == "sep":
            low = F.when(F.col("rendimiento_predicho") < LOW_YIELD, F.array(F.lit(LOW_YIELD_FINDING)))
            found = F.concat(found, F.coalesce(low, F.array().cast("array<string>")))
        agents.append(
            F.struct(
                F.lit(name).alias("agente"),
                F.lit(description).alias("descripcion"),
                F.lit(field).alias("indicador"),
                value.alias("valor"),
                level.alias("nivel"),
                found.alias("hallazgos"),
                _texts(level, recommendations).alias("recomendaciones"),
            )
        )
    order = F.array(*map(F.lit, ORDER))
    top = F.greatest(*[F.array_position(order, level) for level in levels])
    message = F.create_map(*[F.lit(v) for item in MESSAGES.items() for v in item])
    combined = F.array_distinct(F.flatten(F.transform("agentes", lambda a: a["recomendaciones"])))
    return (
        rows.withColumn("agentes", F.array(*agents))
        .withColumn("prioridad", F.element_at(order, top.cast("int")))
        .withColumn("resumen", F.element_at(message, F.col("prioridad")))
        .withColumn("recomendaciones_sintetizadas", F.slice(combined, 1, MAX_RECOMMENDATIONS))
    )
