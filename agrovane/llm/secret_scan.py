"""Secret scan with corpus-wide ownership frequency.

``scan`` finds candidate spans in every whole text, with built-in functions only. ``ownership`` counts, for the hash of
every candidate value, the distinct repositories and owners that hold it: a value that many owners publish is a copied
example, one that stays with a single owner and looks random is treated as a live credential. The classes are those of
op10's SQL, where two owners are enough.

``redact`` asks for more before it leaves a value: copies of one text say nothing about how widely its values are
known, so owners are counted over distinct contexts (the text before a span), one owner per context. Spans of the base
kinds are replaced unless that count is wide, weak values included; of the other kinds, those that look random are.

Spans are found in two readings of a text per kind: the texts before each match give the starts, group captures give the
values. Only texts that hold a keyword of the kind are searched.

Owner and repository are given as columns; for ``documents`` the owner is the source, the repository is source and
language. NULL owners or repositories count as one value of their own.

Defined cases: NULL or empty text has no spans; an empty table gives an empty result; repeated rows and NULL ids are kept
as they are; additional columns are carried or ignored, and working columns start with an underscore.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrovane.llm.common import bound
from agrovane.scale import materialize


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

# kind -> (pattern, group that holds the value, its least length, texts of which one, in lower case, is in any match).
# The first three are the base kinds, in the order in which equal starts are listed.
KINDS = {
    "assign": (f"({_ASSIGN_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    "access": ("AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    "hex": ("[0-9a-f]+", 0, 24, ()),
    "bearer": ("[Bb]earer\\x20+([A-Za-z0-9+/_.~=-]+)", 1, 16, ("bearer ",)),
    "jwt": ("eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 32, ("eyj",)),
    "forge": ("gh[opsu]_[A-Za-z0-9]+", 0, 24, ("gho_", "ghp_", "ghs_", "ghu_")),
    "login": ("[a-z][a-z0-9+]*://[^\\x20\\x09-\\x0D/:@]+:([^\\x20\\x09-\\x0D/:@]+)@", 1, 4, ("://",)),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x09-\\x0D]+", 0, 48, ("private key-----",)),
}
BASE_KINDS = ("assign", "access", "hex")
LIVE, SHARED, WEAK = "live", "shared", "weak"
#: A value that so many owners hold is an example.
SHARED_OWNERS = 2
#: A live-looking value has so many characters, and so many different ones.
LIVE_LENGTH, LIVE_DISTINCT = 12, 6
#: Redaction leaves a value that so many owners hold in contexts of their own; a context is so many characters.
EXAMPLE_OWNERS, CONTEXT = 5, 40
SALTS = 8


def _cast_empty() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,hash:string,strong:boolean,context:bigint>>")


def spans_of(text: Column, lower: Column, kind: str) -> Column:
    """Spans of one kind, leftmost and not overlapping, matches with too short a value left out."""
    pattern, group, least, keywords = KINDS[kind]
    rank = list(KINDS).index(kind)
    # Each match goes on where the one before it ended (\\G); without it the text after the last one is read again and again.
    split = F.lit(f"\\G(?s)(.*?)({pattern})")
    gate = reduce(or_, [lower.contains(k) for k in keywords]) if keywords else text.rlike(f"{pattern[:-1]}{{{least}}}")

    def placed(found: Column) -> Column:
        # found: gap before each match, the match, its value. A match starts where all before it and its gap end.
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["whole"])
            span = F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                end.alias("end"),
                F.sha2(x["value"], 256).alias("hash"),
                (
                    (F.char_length(x["value"]) >= LIVE_LENGTH)
                    & (F.size(F.array_distinct(F.split(x["value"], ""))) >= LIVE_DISTINCT)
                ).alias("strong"),
                # The text between the match before it and this one, as far as it belongs to the context.
                F.xxhash64(F.right(x["gap"], F.lit(CONTEXT))).alias("context"),
            )
            more = F.when(F.char_length(x["value"]) >= least, F.array(span)).otherwise(_cast_empty())
            return F.struct(end.alias("at"), F.concat(state["out"], more).alias("out"))

        start = F.struct(F.lit(0).alias("at"), _cast_empty().alias("out"))
        return F.aggregate(found, start, step, lambda state: state["out"])

    parts = [F.regexp_extract_all(text, split, F.lit(k)).alias(name) for k, name in ((1, "gap"), (2, "whole"), (2 + group, "value"))]
    return F.when(gate, placed(F.arrays_zip(*parts))).otherwise(_cast_empty())


def scan(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns and ``spans``, ordered by start and kind: (start, rank, kind, end, hash of the value, strong)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = bound(
        F.lower(text), lambda lower: F.array_sort(F.concat(*[spans_of(text, lower, kind) for kind in KINDS]))
    )
    return docs.select(*[F.col(f"`{c}`") for c in carry], spans.alias("_spans"))


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per candidate hash: occurrences, distinct repositories and owners, the class, and whether redaction leaves it.

    Equal (hash, owner, repository) rows are folded before any hash meets, and owners are folded per hash before they are
    counted, so a value that stands everywhere costs one row per task and owner.
    """
    each = found.select(F.explode("_spans").alias("s"), owner.alias("o"), repository.alias("r")).select(
        F.col("s.hash").alias("hash"), F.col("s.strong").alias("strong"), F.col("s.context").alias("context"), "o", "r"
    )
    by_context = each.groupBy("hash", "context").agg(F.min("o").alias("o"))
    spread = by_context.groupBy("hash", "o").agg(F.lit(1).alias("one")).groupBy("hash").agg(
        (F.count(F.lit(1)) >= EXAMPLE_OWNERS).alias("example")
    )
    by_repository = each.groupBy("hash", "o", "r").agg(F.count(F.lit(1)).alias("n"), F.max("strong").alias("strong"))
    by_owner = by_repository.groupBy("hash", "o").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"), F.max("strong").alias("strong")
    )
    counted = by_owner.groupBy("hash").agg(
        F.sum("n").alias("occurrences"),
        F.sum("repositories").alias("repositories"),
        F.count(F.lit(1)).alias("owners"),
        F.max("strong").alias("strong"),
    )
    verdict = F.when(F.col("owners") >= SHARED_OWNERS, SHARED).when(F.col("strong"), LIVE).otherwise(WEAK)
    return counted.withColumn("class", verdict).join(spread, "hash")


def judged(found: DataFrame, owners: DataFrame) -> DataFrame:
    """``found`` (a stored table with a unique ``_row``) with ``classes``: kind, start, end, class and redaction of each span.

    Each hash of ``owners`` is spread over a few salts, so a value in a third of all rows meets it in several tasks.
    """
    each = found.select("_row", F.explode("_spans").alias("s")).select(
        "_row", "s.*", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("_salt")
    )
    spread = owners.select("hash", "class", "example", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    base = F.col("rank") < len(BASE_KINDS)
    classed = each.join(spread, ["hash", "_salt"]).withColumn("blank", ~F.col("example") & (base | F.col("strong")))
    grouped = classed.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "class", "blank"))).alias("classes")
    )
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,class:string,blank:boolean>>")
    return found.join(grouped, "_row", "left").withColumn("classes", F.coalesce("classes", none))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_verdicts(docs: DataFrame, owner: Column, repository: Column, *carry: str) -> DataFrame:
    """Documents (``carry`` columns) with their spans and the class of each."""
    found = materialize(scan(docs, *carry).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    holders = found.where(F.size("_spans") > 0)
    owners = ownership(holders, owner, repository)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,class:string,blank:boolean>>")
    clean = found.where(F.size("_spans") == 0).withColumn("classes", none)
    return judged(holders, owners).unionByName(clean)


def redact(text: Column, classes: Column) -> Column:
    """``text`` with each span to be redacted replaced by its kind in brackets; overlapping spans become one."""

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    blank = F.filter(classes, lambda s: s["blank"])
    done = F.aggregate(blank, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, 2147483647)))
    return F.when(F.size(blank) > 0, done).otherwise(text)


def owner_columns() -> tuple[Column, Column]:
    """Owner and repository of a row of ``documents``."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def op10(docs: DataFrame) -> DataFrame:
    """Span counts, the digest of the base spans, all spans and their classes per document."""
    rows = with_verdicts(docs, *owner_columns(), "doc_id", "source", "lang")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE_KINDS))
    of_kind = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    of_class = lambda name: F.size(F.filter("classes", lambda s: s["class"] == name)).cast("long")
    return rows.select(
        "doc_id",
        *[of_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        of_class(LIVE).alias("n_live"),
        of_class(SHARED).alias("n_shared"),
    )
