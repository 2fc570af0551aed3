"""Registered queries: one per operator or tight group, over the whole test tables."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrovane.functions.text import normalize_name
from agrovane.ml import histboost, isolation, network, supervised, trees
from agrovane.ml.evaluation import evaluate_models
from agrovane.operators import assembly, clean, climate, forest, names, production, scoring, serving, stations
from agrovane.plans import pipeline
from agrovane.scale import materialize, shared_folder
from agrovane.session import configure
from agrovane.sources import landing
from agrovane.sources.fixtures import Fixtures
from agrovane.sources.schemas import KEY, PREDICTOR_COLUMNS, SOCIO
from agrovane.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 5
UNIT_DIGITS = 7  # for values in [0, 1], where decimal ties at 5 digits are common
AS_OF = dt.date(2001, 12, 31)

_stored: dict[tuple[str, str, str], object] = {}


def query(function: Query) -> Query:
    """Register a query; it runs with the recommended session options (UTC days, AQE)."""

    @functools.wraps(function)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return function(configure(spark), sf)

    QUERIES[function.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at a fixed number of digits, so that summation order does not show."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def stored(fx: Fixtures, name: str, build: Callable[[], object]):
    """A layer table that several queries read, built once per application and folder like a pipeline step."""
    key = (fx.spark.sparkContext.applicationId, fx.folder, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def master_table(fx: Fixtures) -> DataFrame:
    return stored(fx, "master", lambda: materialize(pipeline.master(fx), "master"))


def scored(fx: Fixtures) -> pipeline.Scored:
    return stored(fx, "scored", lambda: pipeline.score(master_table(fx), stored=True))


def supervised_table(fx: Fixtures) -> DataFrame:
    return stored(fx, "supervised", lambda: materialize(supervised.supervised_set(master_table(fx)), "supervised"))


def plain_predictions(fx: Fixtures) -> DataFrame:
    """A closed-form prediction, so that everything after the models can be checked in SQL."""
    guess = F.col("target") * 0.9 + F.col("precip_acum_7d") / 1000 + F.col("tmin_media_30d") / 100
    return supervised_table(fx).withColumn("prediction", guess)


def plain_raw_scores(fx: Fixtures) -> DataFrame:
    return scored(fx).scores.select(*KEY, F.lit("*").alias("modelo"), (-(F.col("spc") + F.col("sve")) / 2).alias("raw"))


def results_table(fx: Fixtures) -> DataFrame:
    """Result table with closed-form anomaly and yield inputs, so that assembly and serving can be checked in SQL."""

    def build() -> DataFrame:
        trees_like = trees.boosted_interval(plain_predictions(fx)).select(
            *KEY,
            "rendimiento_predicho",
            "rendimiento_ic_inf",
            "rendimiento_ic_sup",
            F.when(F.month("periodo") != 6, F.lit('[{"var":"area_sembrada","importance":0.5}]'))
            .otherwise(F.lit("{broken"))
            .alias("importancia_top3"),
        )
        anomalies = isolation.rescale(materialize(plain_raw_scores(fx), "raw-scores"))
        return materialize(
            assembly.assemble_results(
                scored(fx).scores, anomalies, trees_like, network.network_interval(plain_predictions(fx))
            ),
            "results",
        )

    return stored(fx, "results", build)


def fitted_table(fx: Fixtures) -> DataFrame:
    """Result table of the fitted models, at the library defaults (the served layer)."""
    return stored(fx, "fitted", lambda: materialize(pipeline.full_results(scored(fx)), "fitted"))


def forest_tables(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """The wide loss tables (all and primary forest)."""

    def build():
        landed, unit = fx.loss_landed(), forest.unit_names(fx.adm_names())
        return tuple(
            materialize(forest.loss_wide(forest.name_units(forest.loss_by_year(landed, primary), unit)), "loss")
            for primary in (False, True)
        )

    return stored(fx, "loss", build)


def loss_rows(fx: Fixtures) -> DataFrame:
    wide, primary = forest_tables(fx)
    return forest.with_primary(
        forest.loss_long(wide, start_year=0), forest.loss_long(primary, "primary_loss_ha", 0)
    )


def loss_feature_table(fx: Fixtures) -> DataFrame:
    def build():
        rows = loss_rows(fx)
        resolved = materialize(names.resolve_names(rows, fx.zone_names()), "resolved-names")
        return materialize(forest.loss_features(names.attach_codes(rows, resolved)), "loss-features")

    return stored(fx, "loss_features", build)


def resolved_places(fx: Fixtures) -> DataFrame:
    return stored(
        fx,
        "places",
        lambda: materialize(names.resolve_names(fx.place_mentions(), fx.place_dictionary()), "resolved-names"),
    )


# --- scans, cleaning -------------------------------------------------------------------------------------------


@query
def clean_production(spark, sf):
    return rounded(clean.clean_production(Fixtures(spark, sf).production_raw()))


@query
def clean_ndvi(spark, sf):
    return rounded(clean.clean_ndvi(Fixtures(spark, sf).ndvi_raw()))


@query
def clean_passthrough(spark, sf):
    """Schema enforcement: the declared columns in order, absent ones as NULL."""
    return rounded(clean.clean_passthrough(clean.socioeconomic(Fixtures(spark, sf).socio()).drop("departamento"), SOCIO))


@query
def zone_code(spark, sf):
    return rounded(clean.poverty_by_zone(Fixtures(spark, sf).nbi_raw()))


@query
def rural_share(spark, sf):
    return rounded(clean.socioeconomic(Fixtures(spark, sf).socio()))


@query
def source_cutoff(spark, sf):
    """Rows of the last two years before the reference day, counted per station."""
    recent = landing.since(Fixtures(spark, sf).observations("temperatura"), "fechaobservacion", AS_OF, 2)
    return rounded(
        recent.groupBy("codigoestacion").agg(F.count(F.lit(1)).alias("filas"), F.avg("valorobservado").alias("media"))
    )


@query
def newest_readings(spark, sf):
    """The newest 600 wind readings (top-k report)."""
    fx = Fixtures(spark, sf)
    wind = fx.observations("viento").withColumn("fecha", F.col("fechaobservacion").cast("date"))
    newest = landing.newest(wind, "fecha", 600, ["codigoestacion", "valorobservado"])
    return rounded(newest.select("codigoestacion", "fecha", "valorobservado"))


@query
def column_synonyms(spark, sf):
    """Station catalogue found by column-name parts; unreadable coordinates dropped."""
    return rounded(stations.station_points(Fixtures(spark, sf).points()))


@query
def footer_rows(spark, sf):
    """Rows are dropped only if all core columns are NULL, against rows dropped if any is."""
    raw = Fixtures(spark, sf).nbi_raw()
    typed = raw.select("nom_mun", "cod_mun", F.trim("nbi_total").try_cast("double").alias("valor"))
    all_null = clean.drop_footer(typed, ["cod_mun", "valor"]).withColumn("regla", F.lit("todas"))
    any_null = clean.require(typed, ["cod_mun", "valor"]).withColumn("regla", F.lit("alguna"))
    return rounded(all_null.unionByName(any_null))


@query
def dedup_by_key(spark, sf):
    """First row per key by an explicit order."""
    fx = Fixtures(spark, sf)
    lines = fx.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return rounded(clean.first_per_key(lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"]))


@query
def landing_profile(spark, sf):
    fx = Fixtures(spark, sf)
    parts = [
        clean.landing_profile(fx.observations(k), k)
        for k in ("precipitacion", "temperatura", "humedad", "presion", "tambiente", "viento")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- names -----------------------------------------------------------------------------------------------------


@query
def name_normalize(spark, sf):
    fx = Fixtures(spark, sf)
    return (
        fx.place_mentions()
        .select("municipio")
        .distinct()
        .select("municipio", normalize_name(F.col("municipio")).alias("clave"))
    )


@query
def name_normalize_unicode(spark, sf):
    """Compatibility decomposition of whole texts, with the vectorised fold."""
    docs = Fixtures(spark, sf).table("documents")
    return docs.select("doc_id", F.md5(normalize_name(F.col("text"), "unicode")).alias("huella"))


@query
def name_match_cascade(spark, sf):
    return resolved_places(Fixtures(spark, sf)).select("departamento", "municipio", "codigo_municipio", "via")


@query
def name_match_fuzzy(spark, sf):
    fx = Fixtures(spark, sf)
    # One normalisation per distinct spelling, not per mention.
    keys = fx.place_mentions().select("municipio").distinct().select(normalize_name(F.col("municipio")).alias("clave"))
    candidates = names.name_dictionary(fx.place_dictionary()).filter("bare")
    return names.match_fuzzy(keys, candidates)


@query
def name_match_report(spark, sf):
    fx = Fixtures(spark, sf)
    return names.match_report(fx.place_mentions(), resolved_places(fx))


# --- stations and climate --------------------------------------------------------------------------------------


@query
def station_attach(spark, sf):
    fx = Fixtures(spark, sf)
    rows = stations.attach_zone(fx.observations("precipitacion"), fx.stations())
    return rounded(
        rows.groupBy("codigo_municipio", "nombre_municipio").agg(
            F.count(F.lit(1)).alias("filas"), F.sum("valorobservado").alias("suma")
        )
    )


def _zones(fx: Fixtures) -> DataFrame:
    return landing.zones_from_features(fx.zone_features())


@query
def station_zone_spatial(spark, sf):
    fx = Fixtures(spark, sf)
    placed = stations.stations_to_zones(stations.station_points(fx.points()), _zones(fx), cell=5.0)
    return rounded(placed)


def _rain(fx: Fixtures) -> DataFrame:
    return climate.rain_daily(fx.observations("precipitacion"), fx.stations())


@query
def rain_daily(spark, sf):
    return rounded(_rain(Fixtures(spark, sf)))


@query
def rain_rolling7(spark, sf):
    return rounded(climate.rain_rolling(_rain(Fixtures(spark, sf))))


@query
def rain_p95_days(spark, sf):
    days = climate.extreme_rain(_rain(Fixtures(spark, sf)))
    return rounded(
        days.groupBy("codigo_municipio").agg(
            F.max("umbral").alias("umbral"),
            F.count_if(F.col("precip_dia") > F.col("umbral")).alias("dias_lluvia_extrema"),
        )
    )


@query
def dry_streak(spark, sf):
    return climate.dry_streaks(_rain(Fixtures(spark, sf)))


@query
def rain_monthly(spark, sf):
    return rounded(climate.rain_monthly(_rain(Fixtures(spark, sf))))


@query
def tmax_monthly(spark, sf):
    fx = Fixtures(spark, sf)
    return rounded(climate.tmax_monthly(fx.observations("temperatura"), fx.stations()))


@query
def humidity_monthly(spark, sf):
    fx = Fixtures(spark, sf)
    return rounded(climate.humidity_monthly(fx.observations("humedad"), fx.stations()))


@query
def pressure_monthly(spark, sf):
    fx = Fixtures(spark, sf)
    return rounded(climate.pressure_monthly(fx.observations("presion"), fx.stations()))


@query
def ambient_monthly(spark, sf):
    fx = Fixtures(spark, sf)
    return rounded(climate.ambient_monthly(fx.observations("tambiente"), fx.stations()))


@query
def wind_monthly(spark, sf):
    fx = Fixtures(spark, sf)
    return rounded(climate.wind_monthly(fx.observations("viento"), fx.stations()))


@query
def climate_outer(spark, sf):
    return rounded(pipeline.climate(Fixtures(spark, sf)))


@query
def ndvi_monthly(spark, sf):
    return rounded(climate.ndvi_monthly(clean.clean_ndvi(Fixtures(spark, sf).ndvi_raw())))


# --- production, prices, socio-economic ------------------------------------------------------------------------


@query
def yield_stats(spark, sf):
    return rounded(production.yield_stats(Fixtures(spark, sf).production()))


@query
def crop_share(spark, sf):
    return rounded(production.crop_share(production.yield_stats(Fixtures(spark, sf).production())))


@query
def crop_calendar(spark, sf):
    """Calendar by crop and zone."""
    fx = Fixtures(spark, sf)
    stats = production.yield_stats(fx.production())
    return rounded(production.attach_calendar(stats, fx.crop_zone_calendar()))


@query
def price_features(spark, sf):
    return rounded(production.price_features(Fixtures(spark, sf).input_prices()))


@query
def socio_features(spark, sf):
    """The poverty sheet alone: the columns it lacks are typed NULLs."""
    return rounded(production.socio_features(clean.poverty_by_zone(Fixtures(spark, sf).nbi_raw())))


# --- forest ----------------------------------------------------------------------------------------------------


@query
def loss_by_year(spark, sf):
    landed = Fixtures(spark, sf).loss_landed()
    every = forest.loss_by_year(landed).withColumn("primaria", F.lit(False))
    return rounded(every.unionByName(forest.loss_by_year(landed, True).withColumn("primaria", F.lit(True))))


@query
def loss_named(spark, sf):
    """Loss rows with administrative names, and the rows without one as a count."""
    fx = Fixtures(spark, sf)
    long, unit = forest.loss_by_year(fx.loss_landed()), forest.unit_names(fx.adm_names())
    named = forest.name_units(long, unit).groupBy("departamento", "municipio").agg(
        F.count(F.lit(1)).alias("filas"), F.sum("ha").alias("ha")
    )
    dropped = forest.unnamed_units(long, unit).agg(F.count(F.lit(1)).alias("filas"), F.sum("ha").alias("ha")).select(
        F.lit("(sin nombre)").alias("departamento"), F.lit("(sin nombre)").alias("municipio"), "filas", "ha"
    )
    return rounded(named.unionByName(dropped))


@query
def loss_pivot(spark, sf):
    return rounded(forest_tables(Fixtures(spark, sf))[0])


@query
def loss_unpivot(spark, sf):
    return rounded(forest.loss_long(forest_tables(Fixtures(spark, sf))[0], start_year=1996))


@query
def loss_primary(spark, sf):
    return rounded(loss_rows(Fixtures(spark, sf)))


@query
def loss_features(spark, sf):
    return rounded(loss_feature_table(Fixtures(spark, sf)))


@query
def loss_trend(spark, sf):
    features = loss_feature_table(Fixtures(spark, sf))
    return rounded(features.groupBy("deforestacion_tendencia_label").agg(
        F.count(F.lit(1)).alias("zonas"), F.avg("deforestacion_tendencia").alias("pendiente_media")
    ))


# --- master and scores -----------------------------------------------------------------------------------------


@query
def master_features(spark, sf):
    return rounded(master_table(Fixtures(spark, sf)))


@query
def normalize_bounds(spark, sf):
    return rounded(scoring.robust_bounds(master_table(Fixtures(spark, sf))))


@query
def normalized_features(spark, sf):
    return rounded(scored(Fixtures(spark, sf)).normalized, UNIT_DIGITS)


@query
def subindices(spark, sf):
    return rounded(scoring.subindices(scored(Fixtures(spark, sf)).normalized).select(*KEY, "spc", "sep", "sve"), UNIT_DIGITS)


@query
def risk_scores(spark, sf):
    return rounded(scored(Fixtures(spark, sf)).scores, UNIT_DIGITS)


@query
def level_distribution(spark, sf):
    return scoring.level_distribution(scored(Fixtures(spark, sf)).scores)


# --- models ----------------------------------------------------------------------------------------------------


@query
def next_target(spark, sf):
    """Supervised set; the target follows a yield that varies by period."""
    fx = Fixtures(spark, sf)
    varying = master_table(fx).withColumn("rendimiento", F.col("rendimiento_promedio") + F.col("precip_acum_7d") / 100)
    rows = supervised.supervised_set(varying, "rendimiento")
    return rounded(rows.select(*KEY, "area_sembrada", "humedad_media_30d", "target"))


@query
def standardized(spark, sf):
    rows = supervised_table(Fixtures(spark, sf))
    return rounded(supervised.Standardizer.fit(rows, PREDICTOR_COLUMNS).transform(rows).drop("target"), 4)


@query
def cv_folds(spark, sf):
    rows = supervised_table(Fixtures(spark, sf)).select(*KEY)
    per_crop = supervised.contiguous_folds(rows).withColumn("alcance", F.lit("cultivo"))
    overall = supervised.contiguous_folds(rows, by_crop=False).withColumn("alcance", F.lit("global"))
    return per_crop.unionByName(overall)


@query
def temporal_split(spark, sf):
    rows = supervised_table(Fixtures(spark, sf))
    train, test, cutoff = supervised.temporal_split(rows)
    side = lambda df, name: df.agg(
        F.count(F.lit(1)).alias("filas"), F.min("periodo").alias("desde"), F.max("periodo").alias("hasta")
    ).select(F.lit(name).alias("lado"), "filas", "desde", "hasta", F.lit(cutoff).alias("periodo_corte"))
    return side(train, "train").unionByName(side(test, "test"))


@query
def model_metrics(spark, sf):
    predicted = plain_predictions(Fixtures(spark, sf))
    every = supervised.regression_metrics(predicted.withColumn("modelo", F.lit("todos")), ["modelo"])
    return every.unionByName(supervised.regression_metrics(predicted.withColumn("modelo", F.col("cultivo")), ["modelo"]))


@query
def yield_interval(spark, sf):
    columns = [*KEY, "rendimiento_predicho", "rendimiento_ic_inf", "rendimiento_ic_sup"]
    return trees.boosted_interval(plain_predictions(Fixtures(spark, sf))).select(*columns)


@query
def network_interval(spark, sf):
    return network.network_interval(plain_predictions(Fixtures(spark, sf)))


@query
def anomaly_rescale(spark, sf):
    raw = materialize(plain_raw_scores(Fixtures(spark, sf)), "raw-scores")
    return rounded(isolation.rescale(raw))


@query
def anomaly_forest(spark, sf):
    """Isolation forest over the normalised features of all rows."""
    fx = Fixtures(spark, sf)
    normalized = scored(fx).normalized
    nodes = materialize(isolation.fit_forest(normalized), "forest")
    return isolation.rescale(materialize(isolation.raw_scores(normalized, nodes), "raw-scores"))


@query
def anomaly_forest_by_crop(spark, sf):
    """One isolation forest per crop."""
    fx = Fixtures(spark, sf)
    normalized = scored(fx).normalized
    nodes = materialize(isolation.fit_forest(normalized, scope="group"), "forest")
    return isolation.rescale(materialize(isolation.raw_scores(normalized, nodes, scope="group"), "raw-scores"))


@query
def yield_tree(spark, sf):
    """Boosted trees with interval and drivers, one model for all crops."""
    rows = supervised_table(Fixtures(spark, sf))
    return trees.predict(rows, trees.fit_models(rows, trees.boosted_trees(), scope="global"))


@query
def yield_tree_forest(spark, sf):
    """Random forest (depth 12, leaves of 5) with the interval from its single trees."""
    rows = supervised_table(Fixtures(spark, sf))
    return trees.predict(rows, trees.fit_models(rows, trees.random_forest(), scope="global"))


@query
def yield_drivers(spark, sf):
    """Importances of a boosted model per crop with at least 50 rows, all crops boosted together (200 trees)."""
    rows = supervised_table(Fixtures(spark, sf))
    return histboost.fit(rows).importances()


@query
def yield_mlp(spark, sf):
    """Network prediction with interval."""
    fx = Fixtures(spark, sf)
    rows = supervised.supervised_set(master_table(fx), require_current=False)
    return network.predict(rows, network.YieldNetwork.fit(rows))


@query
def model_evaluation(spark, sf):
    """Both model kinds on the temporal hold-out."""
    rows = supervised_table(Fixtures(spark, sf))
    return evaluate_models(rows).drop("generado_en")


@query
def result_assembly(spark, sf):
    return rounded(results_table(Fixtures(spark, sf)))


# --- serving ---------------------------------------------------------------------------------------------------


def served(function: Callable[[Fixtures, DataFrame, DataFrame], DataFrame]) -> Callable:
    """Register a serving query as ``fitted_…`` over the fitted results, and by its own name over the closed-form frame
    that its SQL describes: the arithmetic check of assembly and serving."""
    for name, table in ((f"fitted_{function.__name__}", fitted_table), (function.__name__, results_table)):

        def run(spark, sf, table=table):
            fx = Fixtures(spark, sf)
            return function(fx, table(fx), fx.stations())

        run.__name__, run.__doc__ = name, function.__doc__
        query(run)
    return function


@query
def full_results(spark, sf):
    """The served result table with fitted anomaly, tree and network models."""
    return fitted_table(Fixtures(spark, sf))


@served
def filters(fx, results, known):
    return serving.filters(results, known)


@served
def ranking(fx, results, known):
    return rounded(serving.ranking(results, known, limit=50))


@served
def ranking_page(fx, results, known):
    """Second page, ascending, one department."""
    return rounded(serving.ranking(results, known, department="ASIA", order="asc", limit=20, offset=20))


@served
def ranking_search(fx, results, known):
    """All rows that a search finds, with and without regard to accents."""
    plain = serving.ranking_rows(results, known, search="nd#1")
    return rounded(plain.unionByName(serving.ranking_rows(results, known, search="nation_2", accent_insensitive=True)))


@served
def ranking_total(fx, results, known):
    return serving.ranking_rows(results, known, crop="brand#7").agg(F.count(F.lit(1)).alias("total"))


@served
def map_layer(fx, results, known):
    return rounded(serving.map_layer(results, _zones(fx)).drop("feature"))


@served
def zone_history(fx, results, known):
    columns = [*KEY, "ira_score", "ira_nivel", "anomaly_score", "rendimiento_predicho", "nombre_municipio"]
    # Zone, crop and year of the first result row, so that every scale has rows to show (one row to the driver).
    present = results.where(F.col("codigo_municipio").isNotNull() & F.col("cultivo").isNotNull() & F.col("periodo").isNotNull())
    first = present.agg(F.min(F.struct("codigo_municipio", "cultivo", "periodo")).alias("m")).first()["m"]
    if first is None:
        return rounded(serving.zone_history(results.limit(0), known, "").select(*columns))
    year = str(first["periodo"])[:4]
    return rounded(serving.zone_history(results, known, first["codigo_municipio"], crop=first["cultivo"], period=year).select(*columns))


@served
def crop_history(fx, results, known):
    return rounded(serving.crop_history(results).select(*KEY, "ira_score", "rendimiento_predicho"))


@served
def latest_per_crop(fx, results, known):
    return rounded(serving.latest_per_crop(results))


@served
def default_period(fx, results, known):
    return rounded(serving.default_rows(results).select(*KEY, "ira_score", "rendimiento_predicho"))


@served
def general_summary(fx, results, known):
    summary = serving.general_summary(results, known)
    return rounded(
        summary.select(
            "codigo_municipio",
            "nombre_municipio",
            "nombre_departamento",
            "total_cultivos",
            "ira_promedio",
            *[F.coalesce(F.try_element_at("distribucion_niveles", F.lit(n)), F.lit(0)).alias(a)
              for n, a in (("Bajo", "bajo"), ("Medio", "medio"), ("Alto", "alto"), ("Crítico", "critico"))],
            F.array_join("mayor_riesgo.cultivo", ",").alias("mayor_riesgo"),
            F.array_join("menor_riesgo.cultivo", ",").alias("menor_riesgo"),
        )
    )


@served
def report_summary(fx, results, known):
    return rounded(
        serving.report_summary(results, known).select(
            "codigo_municipio",
            "total_cultivos",
            "ira_promedio",
            "spc_promedio",
            "sep_promedio",
            "sve_promedio",
            "rendimiento_promedio",
            "cultivos_con_rendimiento",
            F.element_at("top3.cultivo", 1).alias("mayor"),
            F.element_at("bottom3.cultivo", 1).alias("menor"),
        )
    )


@served
def crop_context(fx, results, known):
    return rounded(
        serving.crop_context(results, known, "1999-06-01").select(
            "codigo_municipio",
            "cultivo",
            "periodo_seleccionado",
            "ira_score",
            "rendimiento_ic_inf",
            "rendimiento_ic_sup",
            "rendimiento_nnet",
            "is_anomaly",
            F.try_element_at("importancia_top3.var", F.lit(1)).alias("principal"),
            F.size("historial_del_cultivo").alias("historial"),
            F.element_at("historial_del_cultivo.periodo", 1).alias("mas_reciente"),
            "nombre_municipio",
        )
    )


@served
def parsed_drivers(fx, results, known):
    """Stored driver lists; broken JSON becomes NULL."""
    parsed = serving.parse_top3(F.col("importancia_top3"))
    return results.groupBy("cultivo").agg(
        F.count("importancia_top3").alias("guardados"),
        F.count(parsed).alias("leidos"),
        F.max(parsed[0]["importance"]).alias("importancia"),
    )


@served
def dominant_component(fx, results, known):
    rows = serving.dominant_component(serving.latest_rows(results))
    return rounded(rows.select(*KEY, "componente", "valor_componente"))


def _agents(rows: DataFrame) -> DataFrame:
    return rounded(
        rows.select(
            "codigo_municipio",
            "cultivo",
            "periodo",
            *[F.col("agentes")[i]["nivel"].alias(f"nivel_{c}") for i, c in enumerate(("spc", "sep", "sve"))],
            *[F.size(F.col("agentes")[i]["hallazgos"]).alias(f"hallazgos_{c}") for i, c in enumerate(("spc", "sep", "sve"))],
            F.array_join(F.col("agentes")[1]["hallazgos"], "; ").alias("texto_sep"),
        )
    )


@served
def agent_levels(fx, results, known):
    return _agents(serving.agent_rows(results, known, "cultivo"))


@served
def agent_general(fx, results, known):
    return _agents(serving.agent_rows(results, known, "general"))


@served
def agent_coordinator(fx, results, known):
    return serving.agent_rows(results, known, "cultivo", "1999-06-01").select(
        "codigo_municipio",
        "cultivo",
        "periodo",
        "prioridad",
        "resumen",
        F.array_join("recomendaciones_sintetizadas", "; ").alias("recomendaciones"),
    )


@query
def ndvi_series(spark, sf):
    ndvi = climate.ndvi_monthly(clean.clean_ndvi(Fixtures(spark, sf).ndvi_raw()))
    return rounded(serving.ndvi_series(ndvi))


@query
def loss_digest(spark, sf):
    return rounded(serving.loss_digest(loss_feature_table(Fixtures(spark, sf))))


@query
def context_documents(spark, sf):
    fx = Fixtures(spark, sf)
    results, known = fitted_table(fx), fx.stations()
    ndvi = climate.ndvi_monthly(clean.clean_ndvi(fx.ndvi_raw()))
    return serving.context_documents(results, known, ndvi, loss_feature_table(fx))


# --- streaming -------------------------------------------------------------------------------------------------

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as readings: ten stations, one reading per event."""
    raw = incremental.observation_stream(spark, sf, EVENTS, pathGlobFilter="events.parquet")
    return raw.select(
        (F.col("user_id") % 10).cast("string").alias("codigoestacion"),
        F.col("ts").cast("timestamp").alias("fechaobservacion"),
        F.col("value").alias("valorobservado"),
    )


def _run_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    return incremental.append_available(stream, f"{base}/table", f"{base}/state")


@query
def stream_landing(spark, sf):
    """Landed readings without repeats, summed per station."""
    landed = _run_stream(spark, incremental.deduplicated(_event_stream(spark, sf)))
    return rounded(
        landed.groupBy("codigoestacion").agg(F.count(F.lit(1)).alias("lecturas"), F.sum("valorobservado").alias("suma"))
    )


@query
def stream_daily(spark, sf):
    """Daily totals per zone, days that are still open included."""
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    totals = incremental.daily_totals(_event_stream(spark, sf), Fixtures(spark, sf).stations())
    return rounded(incremental.upsert_available(totals, f"{base}/table", f"{base}/state", ["codigo_municipio", "fecha"], "fecha"))


@query
def stream_refresh(spark, sf):
    """Months touched by landed readings, recomputed."""
    fx = Fixtures(spark, sf)
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    stream = _event_stream(spark, sf)
    incremental.append_available(stream, f"{base}/landed", f"{base}/landing-state")

    def months(rows: DataFrame) -> DataFrame:
        return climate.wind_monthly(rows, fx.stations())

    table = incremental.refresh_months(
        spark, f"{base}/landed", stream.schema, months, f"{base}/months", f"{base}/refresh-state"
    )
    return rounded(table.select("codigo_municipio", F.col("periodo").cast("date").alias("periodo"), "viento_media_30d"))


