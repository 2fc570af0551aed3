"""Resolution of free place names to zone codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrovane.functions.text import normalize_name
from agrovane.scale import materialize, small_side

# Spellings that a bare lookup misses and the name to look up instead.
NAME_ALIASES = {
    "MIRITI PARANA": "MIRITI - PARANA",
    "CAROLINA DEL PRINCIPE": "CAROLINA",
    "EL SOPETRAN": "SOPETRAN",
    "SAN VICENTE": "SAN VICENTE DE CHUCURI",
    "SANTAFE DE ANTIOQUIA": "SANTA FE DE ANTIOQUIA",
    "SAN ESTANISLAO DE KOSTKA": "SAN ESTANISLAO",
    "GUICAN": "GUICAN DE LA SIERRA",
    "PIENDAMA": "PIENDAMO",
    "CARMEN DE APICALA": "EL CARMEN",
    "CAROLINA": "CAROLINA DEL PRINCIPE",
    "EL CARMEN": "CARMEN DE APICALA",
    "PUEBLO BELLO": "PUEBLOBELLO",
    "SANTA ROSA": "SANTA ROSA DE CABAL",
    "SAN PEDRO": "SAN PEDRO DE LOS MILAGROS",
    "SAN LUIS": "SAN LUIS DE PALENQUE",
    "SAN JOSE": "SAN JOSE DE LA MONTANA",
    "SAN JOSE DE PARE": "SAN JOSE DE LA MONTANA",
    "SAN MIGUEL": "SAN MIGUEL DE PUTUMAYO",
    "SAN BENITO": "SAN BENITO ABAD",
    "SAN ANTONIO": "SAN ANTONIO DEL TEQUENDAMA",
}
# Names that are looked up with this department.
DEPARTMENT_FALLBACKS = {
    "SANTA ROSA DEL SUR": "BOLIVAR",
    "TIERRA ALTA": "CORDOBA",
    "SAN BENITO ABAD": "SUCRE",
}

# Word sets up to this size are matched by enumerating their subsets; longer ones by their rarest word.
MAX_ENUMERATED_WORDS = 8


def _lookup(column: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), column)


def name_dictionary(zones: DataFrame, alphabet: str = "spanish") -> DataFrame:
    """``(nombre, codigo, bare)``: every zone under its name and under name plus department.

    A name that several zones share resolves to the greatest code.
    """
    name, department = F.col("nombre_municipio"), F.col("nombre_departamento")
    entries = F.array(
        F.struct(normalize_name(name, alphabet).alias("nombre"), F.lit(True).alias("bare")),
        F.struct(normalize_name(F.concat_ws(" ", name, department), alphabet).alias("nombre"), F.lit(False).alias("bare")),
    )
    return (
        zones.select("codigo_municipio", F.explode(entries).alias("e"))
        .groupBy("e.nombre")
        .agg(F.max("codigo_municipio").alias("codigo"), F.bool_or("e.bare").alias("bare"))
    )


def match_exact(
    names: DataFrame, dictionary: DataFrame, prefer_department: bool = False, alphabet: str = "spanish"
) -> DataFrame:
    """First hit of bare name, alias, name plus department, department fall-back; names without a hit have no row.

    The lookup keys of a name are stacked and joined once, then the hit with the lowest step wins.
    """
    bare = normalize_name(F.col("municipio"), alphabet)
    keyed = names.withColumn("nombre_base", bare)
    alias = normalize_name(_lookup(F.col("nombre_base"), NAME_ALIASES), alphabet)
    with_department = normalize_name(F.concat_ws(" ", "municipio", "departamento"), alphabet)
    fallback_department = _lookup(F.col("nombre_base"), DEPARTMENT_FALLBACKS)
    fallback = normalize_name(
        F.when(fallback_department.isNotNull(), F.concat_ws(" ", F.col("municipio"), fallback_department)), alphabet
    )
    steps = [
        (1, "directo", F.col("nombre_base")),
        (2, "alias", alias),
        (0 if prefer_department else 3, "departamento", with_department),
        (4, "departamento_fijo", fallback),
    ]
    attempts = F.array(
        *[F.struct(F.lit(rank).alias("paso"), F.lit(how).alias("via"), key.alias("nombre")) for rank, how, key in steps]
    )
    tried = keyed.select("departamento", "municipio", F.explode(attempts).alias("t")).select(
        "departamento", "municipio", "t.*"
    )
    hits = tried.join(dictionary.select("nombre", "codigo"), "nombre")
    return (
        hits.groupBy("departamento", "municipio")
        .agg(F.min_by(F.struct("codigo", "via"), "paso").alias("h"))
        .select("departamento", "municipio", F.col("h.codigo").alias("codigo_municipio"), F.col("h.via").alias("via"))
    )


def _words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(name, " ")))


def _subsets(words: Column) -> Column:
    """All non-empty subsets of a sorted word set, each as one text."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1)
    return F.transform(
        masks,
        lambda mask: F.array_join(
            F.filter(words, lambda w, i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0), " "
        ),
    )


def match_fuzzy(
    keys: DataFrame, candidates: DataFrame, max_enumerated: int = MAX_ENUMERATED_WORDS
) -> DataFrame:
    """``(clave, nombre)``: the least candidate whose words contain, or are contained in, the words of the key.

    Containment is turned into equality: the subsets of one side are joined with the full set of the other, and the
    candidates of a subset are first reduced to their least name, so a frequent word never yields all pairs. Sets too
    long to enumerate are found through the rarest word of the smaller set and checked in full. An empty key or
    candidate matches nothing. Both sides are stored once as distinct names: every way reads them, and none of them reads
    the facts again.
    """
    keys = materialize(keys.filter(F.length("clave") > 0).select("clave").distinct(), "fuzzy-keys").withColumn("kw", _words(F.col("clave")))
    names = materialize(candidates.filter(F.length("nombre") > 0).select("nombre").distinct(), "fuzzy-names").withColumn("cw", _words(F.col("nombre")))
    short_key = F.size("kw") <= max_enumerated
    short_name = F.size("cw") <= max_enumerated

    by_set = names.groupBy(F.array_join("cw", " ").alias("set")).agg(F.min("nombre").alias("nombre"))
    contained = keys.filter(short_key).select("clave", F.explode(_subsets(F.col("kw"))).alias("set")).join(by_set, "set")

    by_subset = (
        names.filter(short_name)
        .select("nombre", F.explode(_subsets(F.col("cw"))).alias("set"))
        .groupBy("set")
        .agg(F.min("nombre").alias("nombre"))
    )
    containing = keys.select("clave", F.array_join("kw", " ").alias("set")).join(by_subset, "set")

    word_use = names.select(F.explode("cw").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("uses"))

    def with_rarest(df: DataFrame, name: str, words: str) -> DataFrame:
        """Adds the rarest word; a set with a word that no candidate has is left out (it cannot be contained)."""
        used = df.select(name, words, F.explode(words).alias("w")).join(word_use, "w")
        return (
            used.groupBy(name, words)
            .agg(F.min_by("w", F.struct("uses", "w")).alias("w"), F.count(F.lit(1)).alias("known"))
            .filter(F.col("known") == F.size(words))
            .drop("known")
        )

    long_keys = keys.filter(~short_key).select("clave", "kw", F.explode("kw").alias("w"))
    in_long_keys = long_keys.join(with_rarest(names, "nombre", "cw"), "w").filter(
        F.size(F.array_except("cw", "kw")) == 0
    )
    long_names = names.filter(~short_name).select("nombre", "cw", F.explode("cw").alias("w"))
    in_long_names = with_rarest(keys, "clave", "kw").join(long_names, "w").filter(
        F.size(F.array_except("kw", "cw")) == 0
    )
    found = [df.select("clave", "nombre") for df in (contained, containing, in_long_keys, in_long_names)]
    union = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return union.groupBy("clave").agg(F.min("nombre").alias("nombre"))


def resolve_names(
    names: DataFrame, zones: DataFrame, prefer_department: bool = False, alphabet: str = "spanish"
) -> DataFrame:
    """``(departamento, municipio, codigo_municipio, via)`` for every distinct name; NULL code if nothing matches.

    The facts are read once, for their distinct names; the name-level tables that several steps read are stored.
    """
    distinct = materialize(names.select("departamento", "municipio").distinct(), "names")
    dictionary = materialize(name_dictionary(zones, alphabet), "name-dictionary")
    exact = materialize(match_exact(distinct, dictionary, prefer_department, alphabet), "names-exact")
    missing = materialize(
        distinct.join(
            exact.select("departamento", "municipio"),
            distinct["departamento"].eqNullSafe(exact["departamento"])
            & distinct["municipio"].eqNullSafe(exact["municipio"]),
            "left_anti",
        ).withColumn("clave", normalize_name(F.col("municipio"), alphabet)),
        "names-missing",
    )
    fuzzy = match_fuzzy(missing, dictionary.filter("bare")).join(dictionary.select("nombre", "codigo"), "nombre")
    rest = missing.join(fuzzy, "clave", "left").select(
        "departamento",
        "municipio",
        F.col("codigo").alias("codigo_municipio"),
        F.when(F.col("codigo").isNotNull(), "palabras").alias("via"),
    )
    return exact.unionByName(rest)


def attach_codes(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts with their zone code. Names are resolved once per distinct spelling, never per row.

    ``resolved`` should be a stored table, because its size is probed.
    """
    codes = resolved.filter(F.col("codigo_municipio").isNotNull()).select(
        F.col("departamento").alias("_departamento"), F.col("municipio").alias("_municipio"), "codigo_municipio"
    )
    # A fact may have no department; its name is resolved all the same.
    same = F.col("departamento").eqNullSafe(F.col("_departamento")) & F.col("municipio").eqNullSafe(F.col("_municipio"))
    return facts.join(small_side(codes), same, "left").drop("_departamento", "_municipio")


def match_report(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Matched rows, total rows and distinct unmatched names, as one row."""
    counts = facts.groupBy("departamento", "municipio").agg(F.count(F.lit(1)).alias("filas"))
    found = resolved.filter(F.col("codigo_municipio").isNotNull()).select(
        F.col("departamento").alias("_departamento"), F.col("municipio").alias("_municipio"), "via"
    )
    same = F.col("departamento").eqNullSafe(F.col("_departamento")) & F.col("municipio").eqNullSafe(F.col("_municipio"))
    joined = counts.join(found, same, "left")
    matched = F.coalesce(F.sum(F.when(F.col("via").isNotNull(), F.col("filas"))), F.lit(0))
    return joined.agg(
        matched.alias("coincidencias"),
        F.sum("filas").alias("total"),
        F.count_distinct(F.when(F.col("via").isNull(), F.col("municipio"))).alias("nombres_sin_codigo"),
    )


def unmatched_names(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("codigo_municipio").isNull()).select("municipio").distinct()
