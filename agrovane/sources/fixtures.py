"""Domain tables derived from the test tables (see FIXTURES.md part B). Every view grows with its source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Place names that the alias and department tables know; spread over the name fixture.
FIXTURE_PLACES = ["SOPETRAN", "SANTA FE DE ANTIOQUIA", "PIENDAMO", "PUEBLOBELLO", "SAN BENITO ABAD", "SAN ESTANISLAO"]
FIXTURE_SPELLINGS = ["El Sopetrán", "Santafé de Antioquia", "Piendamá", "Pueblo  Bello", "San Benito", "S. Estanislao"]


class Fixtures:
    """Domain views over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._stations: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stations(self) -> DataFrame:
        if self._stations is None:
            self._stations = (
                self.table("supplier")
                .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select(
                    F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("codigoestacion"),
                    zone("s_nationkey").alias("codigo_municipio"),
                    F.col("n_name").alias("nombre_municipio"),
                    F.lpad(F.col("r_regionkey").cast("string"), 2, "0").alias("codigo_departamento"),
                    F.col("r_name").alias("nombre_departamento"),
                )
            )
        return self._stations

    def observations(self, kind: str) -> DataFrame:
        values = {
            "precipitacion": F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).otherwise(0.0),
            "temperatura": F.col("l_quantity"),
            "presion": F.col("l_extendedprice") / 97,
            "tambiente": F.col("l_quantity") / 2,
        }
        # Two sources know other stations and days than the rest (orders, at ten stations), so the outer join has gaps.
        ordered = {"humedad": F.col("o_totalprice") / 970, "viento": F.col("o_custkey") % 97 + F.lit(0.5)}
        if kind in ordered:
            return self.table("orders").select(
                (F.col("o_custkey") % 10 + 1).alias("codigoestacion"),
                F.col("o_orderdate").alias("fechaobservacion"),
                ordered[kind].alias("valorobservado"),
            )
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("codigoestacion"),
            F.col("l_shipdate").alias("fechaobservacion"),
            values[kind].alias("valorobservado"),
        )

    def _sales(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        )

    def production(self) -> DataFrame:
        return self._sales().select(
            zone("s_nationkey").alias("codigo_municipio"),
            F.lower(F.trim("p_brand")).alias("cultivo"),
            F.col("l_quantity").alias("area_sembrada"),
            (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("area_cosechada"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("rendimiento"),
        )

    def production_raw(self) -> DataFrame:
        blank_if_returned = lambda c: F.when(F.col("l_returnflag") == "R", F.lit("  ")).otherwise(
            F.concat(F.lit(" "), c.cast("string"))
        )
        return self._sales().select(
            F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("c_d_dep"),
            F.col("s_name").alias("departamento"),
            F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("c_d_mun"),
            F.col("s_name").alias("municipio"),
            F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  ")).alias("cultivo"),
            F.concat(F.col("p_type"), F.lit(" ")).alias("grupo_de_cultivo"),
            F.concat(F.lit(" "), F.col("p_type")).alias("subgrupo_de_cultivo"),
            F.col("p_name").alias("desagregaci_n_regional_y"),
            F.year("l_shipdate").cast("string").alias("a_o"),
            F.date_format("l_shipdate", "yyyy-MM").alias("periodo"),
            blank_if_returned(F.col("l_quantity").cast("int")).alias("rea_sembrada_ha"),
            F.col("l_linenumber").cast("string").alias("rea_cosechada_ha"),
            blank_if_returned(F.col("l_extendedprice").cast("decimal(12,2)")).alias("producci_n_t"),
            F.col("l_tax").cast("decimal(6,2)").cast("string").alias("rendimiento_t_ha"),
            F.concat(F.lit("  "), F.col("l_linestatus")).alias("estado_fisico_produccion"),
            F.concat(F.col("p_name"), F.lit(" ")).alias("nombre_cientifico"),
            F.concat(F.col("l_returnflag"), F.lit(" ")).alias("ciclo_de_cultivo"),
        )

    def crop_calendar(self) -> DataFrame:
        number = F.substring_index("p_brand", "#", -1).cast("int")
        return (
            self.table("part")
            .select(F.lower(F.trim("p_brand")).alias("cultivo"), number.alias("k"))
            .distinct()
            .select("cultivo", (F.col("k") % 12 + 1).alias("mes_siembra"), ((F.col("k") + 5) % 12 + 1).alias("mes_cosecha"))
        )

    def crop_zone_calendar(self) -> DataFrame:
        """Calendar per crop and zone, from the parts each zone's suppliers sold."""
        number = F.substring_index("cultivo", "#", -1).cast("int")
        return (
            self.production()
            .select("cultivo", "codigo_municipio")
            .distinct()
            .select(
                F.upper("cultivo").alias("cultivo"),
                "codigo_municipio",
                (number % 12 + 1).alias("mes_siembra"),
                ((number + F.col("codigo_municipio").cast("int")) % 12 + 1).alias("mes_cosecha"),
            )
        )

    def input_prices(self) -> DataFrame:
        """Monthly price index under source names, as text."""
        return (
            self.table("orders")
            .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m"))
            .agg((F.avg("o_totalprice") / 97).alias("v"))
            .select(F.col("m").cast("string").alias("Fecha"), F.col("v").cast("string").alias("Indice"))
        )

    def socio(self) -> DataFrame:
        """Socio-economic source table under source names, as text."""
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("c_nationkey", "n_name")
            .agg(
                (F.avg("c_acctbal") / 97).alias("nbi"),
                F.count_if(F.col("c_mktsegment").isin("FURNITURE", "MACHINERY")).alias("rural"),
                F.count(F.lit(1)).alias("total"),
            )
            .select(
                F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("Cod_DANE"),
                F.concat(F.lit(" "), F.lower("n_name")).alias("municipio"),
                F.col("nbi").cast("string").alias("NBI"),
                F.col("rural").cast("string").alias("resto"),
                F.col("total").cast("string").alias("pob_total"),
            )
        )

    def nbi_raw(self) -> DataFrame:
        """Poverty sheet with separate department and municipality numbers."""
        return (
            self.table("customer")
            .groupBy("c_nationkey", "c_mktsegment")
            .agg((F.avg("c_acctbal") / 97).alias("v"))
            .select(
                F.lit("0").alias("cod_depto"),
                F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).alias(
                    "cod_mun"
                ),
                F.col("c_mktsegment").alias("nom_mun"),
                F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("n.d."))
                .otherwise(F.col("v").cast("string"))
                .alias("nbi_total"),
            )
        )

    def ndvi_raw(self) -> DataFrame:
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.concat(F.lit("CO"), zone("c_nationkey")).alias("PCODE"),
                F.col("o_orderdate").cast("date").cast("string").alias("date"),
                F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("adm_level"),
                F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice") / 500000).alias("vim"),
                F.lit(0.5).alias("vim_avg"),
                ((F.col("o_totalprice") - 250000) / 500000).alias("viq"),
            )
        )

    def loss_landed(self) -> DataFrame:
        """Landed forest-loss rows at their finest grain, with the density threshold and the primary-forest flag."""
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.lit("COL").alias("iso"),
                (F.col("n_regionkey") + 1).cast("string").alias("adm1"),
                (F.col("n_nationkey") + 1).cast("string").alias("adm2"),
                F.year("l_shipdate").cast("string").alias("year"),
                F.when(F.col("l_linestatus") == "O", 30).otherwise(50).alias("threshold"),
                (F.col("l_returnflag") == "A").alias("primary_forest"),
                F.col("l_quantity").alias("ha"),
            )
        )

    def adm_names(self) -> DataFrame:
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.when(F.col("n_nationkey") == 24, F.lit("bad id"))
                .otherwise(F.concat(F.lit("COL."), F.col("n_regionkey") + 1, F.lit("."), F.col("n_nationkey") + 1, F.lit("_1")))
                .alias("gid_2"),
                F.initcap("r_name").alias("name_1"),
                F.initcap(F.translate("n_name", "_", "-")).alias("name_2"),
            )
        )

    def zone_names(self) -> DataFrame:
        """Zone dictionary of the small administrative layer."""
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                zone("n_nationkey").alias("codigo_municipio"),
                F.col("n_name").alias("nombre_municipio"),
                F.col("r_name").alias("nombre_departamento"),
            )
        )

    def place_dictionary(self) -> DataFrame:
        """Large name dictionary: one place per part, some with names that the alias tables target."""
        places = F.array(*map(F.lit, FIXTURE_PLACES))
        pick = (F.col("p_partkey") % len(FIXTURE_PLACES)).cast("int")
        return self.table("part").select(
            F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("codigo_municipio"),
            F.when(F.col("p_size") == 1, places[pick])
            .when(F.col("p_size") == 2, F.concat(F.col("p_name"), F.lit(" del "), F.col("p_type")))
            .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.substring_index("p_brand", "#", -1)))
            .alias("nombre_municipio"),
            F.col("p_type").alias("nombre_departamento"),
        )

    def place_mentions(self) -> DataFrame:
        """Free spellings of places, one per order line: exact, accented, aliased, reordered, shortened or unknown."""
        spellings = F.array(*map(F.lit, FIXTURE_SPELLINGS))
        pick = (F.col("p_partkey") % len(FIXTURE_SPELLINGS)).cast("int")
        brand = F.substring_index("p_brand", "#", -1)
        words = F.split("p_name", " ")
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.initcap("p_type").alias("departamento"),
                F.when(F.col("p_size") == 1, spellings[pick])
                .when(F.col("l_linenumber") == 1, F.concat(F.initcap("p_name"), F.lit(" - "), brand))
                .when(F.col("l_linenumber") == 2, F.concat(brand, F.lit(" "), words[1], F.lit(" "), words[0]))
                .when(F.col("l_linenumber") == 3, F.concat(F.col("p_name"), F.lit(" del")))
                .when(F.col("l_linenumber") == 4, F.translate("p_name", "aeo", "áéó"))
                .when(F.col("l_linenumber") == 5, F.concat(F.lit("Villa "), F.col("p_size").cast("string")))
                .otherwise(F.concat(F.col("p_name"), F.lit(" "), brand))
                .alias("municipio"),
                F.year("l_shipdate").alias("year"),
                F.col("l_quantity").alias("tc_loss_ha"),
            )
        )

    def points(self) -> DataFrame:
        """Station points: one per order, some with unreadable coordinates."""
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("Codigo_Estacion"),
            F.when(F.col("o_orderstatus") == "P", F.lit("?"))
            .otherwise((F.col("o_orderkey") % 1000 / 10).cast("string"))
            .alias("Latitud_Norte"),
            (F.col("o_totalprice") / 5000).cast("string").alias("Longitud_Este"),
        )

    def zone_features(self) -> DataFrame:
        """Polygon layer as GeoJSON features: a grid of rectangles, each with a square hole at its centre.

        Five columns of 20 degrees; a new row every five zones.
        """
        x0 = (F.col("n_nationkey") % 5 * 20).cast("double")
        y0 = (F.floor(F.col("n_nationkey") / 5) * 20).cast("double")

        def ring(xa, ya, xb, yb):
            corner = lambda x, y: F.array(x, y)
            return F.array(corner(xa, ya), corner(xb, ya), corner(xb, yb), corner(xa, yb), corner(xa, ya))

        rings = F.array(ring(x0, y0, x0 + 20, y0 + 20), ring(x0 + 9, y0 + 9, x0 + 11, y0 + 11))
        polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
        multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(rings).alias("coordinates")))
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.create_map(
                    F.lit("MPIO_CDPMP"),
                    zone("n_nationkey"),
                    F.lit("MPIO_CNMBR"),
                    F.col("n_name"),
                    F.lit("DPTO_CCDGO"),
                    F.lpad(F.col("r_regionkey").cast("string"), 2, "0"),
                    F.lit("DPTO_CNMBR"),
                    F.col("r_name"),
                ).alias("properties"),
                F.when(F.col("n_nationkey") % 2 == 0, polygon).otherwise(multi).alias("geometry"),
            )
        )


def zone(column: str):
    """Zone key of a nation number."""
    return F.lpad(F.col(column).cast("string"), 5, "0")
