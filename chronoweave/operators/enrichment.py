"""Concept enrichment from staged search results and entity documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutations import insert_ignore, upsert_coalesce
from .relational import first_per

# Claim properties, language priority, site priority and limits.
CLAIM_PROPERTIES = ("P31", "P279", "P17", "P131", "P361", "P527", "P569", "P570", "P571", "P580", "P582", "P585")
LANGUAGES = ("de", "en")
SITES = ("dewiki", "enwiki")
MAX_VALUES, MAX_LIST_ITEMS = 6, 4
MAX_CONCEPTS, MIN_COUNT, MIN_CONFIDENCE = 400, 2, 0.6


def entity_candidates(
    entities: DataFrame,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    limit: int = MAX_CONCEPTS,
) -> DataFrame:
    """Frequent, confident (name, kind) groups, best first."""
    grouped = (
        entities.filter("name IS NOT NULL AND trim(name) <> ''")
        .groupBy(F.trim("name").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("entity_count"),
            F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 9).alias("avg_confidence"),
        )
        .filter((F.col("entity_count") >= min_count) & (F.col("avg_confidence") >= min_confidence))
    )
    return grouped.orderBy(F.desc("entity_count"), F.desc("avg_confidence"), "name", "kind").limit(limit)


def resolve_concepts(candidates: DataFrame, hits: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds ``qid`` and ``description`` by language priority.

    ``hits(name, language, rank, id, description)``: only the first hit of a language counts, and it
    must be an item id.
    """
    priority = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    first = first_per(hits, ["name", "language"], ["rank"])
    usable = first.withColumn("priority", priority).filter("priority > 0 AND startswith(id, 'Q')")
    best = first_per(usable, ["name"], ["priority"]).select("name", F.col("id").alias("qid"), "description")
    return candidates.join(best, "name")


def claim_value(v: Column) -> Column:
    """Text form of a claim value given as a variant.

    Scalars as text; objects by id, then time (sign and clock cut), text, amount, else JSON; lists as
    JSON of their first four items.
    """

    def text_at(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))

    time = F.substring_index(F.regexp_replace(text_at("$.time"), r"^\++", ""), "T", 1)
    kind = F.schema_of_variant(v)
    as_object = F.coalesce(text_at("$.id"), time, text_at("$.text"), text_at("$.amount"), F.to_json(v))
    items = F.try_variant_get(v, "$", "array<variant>")
    as_list = F.concat(
        F.lit("["),
        F.array_join(F.transform(F.slice(items, 1, MAX_LIST_ITEMS), lambda i: F.to_json(i)), ","),
        F.lit("]"),
    )
    scalar = F.try_variant_get(v, "$", "string")
    flag = F.when(kind == "BOOLEAN", F.initcap(scalar)).otherwise(scalar)
    return (
        F.when(kind.startswith("OBJECT"), as_object)
        .when(kind.startswith("ARRAY"), as_list)
        .when(kind == "VOID", None)
        .otherwise(flag)
    )


def claim_rows(
    docs: DataFrame, key: str, doc: str = "doc", properties: tuple[str, ...] = CLAIM_PROPERTIES, max_values: int = MAX_VALUES
) -> DataFrame:
    """(key, property, value) of variant entity documents.

    The first ``max_values`` statements of a property are taken before those without a value drop.
    """
    per_property = docs.select(
        key,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("property"),
                        F.slice(F.try_variant_get(doc, f"$.claims.{p}", "array<variant>"), 1, max_values).alias("statements"),
                    )
                    for p in properties
                ]
            )
        ).alias("p"),
    )
    statements = per_property.select(key, "p.property", F.explode("p.statements").alias("s")).filter(
        F.try_variant_get("s", "$.mainsnak.snaktype", "string") == "value"
    )
    raw = F.try_variant_get("s", "$.mainsnak.datavalue.value", "variant")
    values = statements.select(key, "property", raw.alias("raw")).filter("raw IS NOT NULL")
    return (
        values.select(key, "property", claim_value(F.col("raw")).alias("value"))
        .filter("value IS NOT NULL AND value <> ''")
        .distinct()
    )


def preferred_site_url(doc: Column | str) -> Column:
    urls = [F.nullif(F.try_variant_get(doc, f"$.sitelinks.{s}.url", "string"), F.lit("")) for s in SITES]
    return F.coalesce(*urls)


def map_concepts(concepts: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (episode, concept, score) where trimmed name and kind agree."""
    mentions = entities.select(
        "episode_id", F.trim("name").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind")
    ).distinct()
    return mentions.join(concepts, ["name", "kind"]).select(
        "episode_id", "concept_id", F.col("avg_confidence").alias("score"), "entity_count", "name"
    )


def enrich(
    entities: DataFrame,
    hits: DataFrame,
    documents: DataFrame,
    concepts: DataFrame,
    bridge: DataFrame,
    claims: DataFrame,
    overwrite: bool = False,
    **limits,
) -> dict[str, DataFrame]:
    """Concept, bridge and claim tables after enrichment, plus one row of counts.

    ``documents(qid, doc variant)``; ``concepts(qid, name, kind, url, description, entity_count,
    avg_confidence)`` is keyed by ``qid``, which is the concept id.
    """
    if overwrite:
        concepts, bridge, claims = (t.limit(0) for t in (concepts, bridge, claims))
    candidates = entity_candidates(entities, **limits)
    found = resolve_concepts(candidates, hits).join(documents, "qid")
    batch = found.select(
        "qid", "name", "kind", preferred_site_url("doc").alias("url"), "description", "entity_count", "avg_confidence"
    )
    # several names may lead to one item: the least frequent candidate comes last and wins
    order = [F.col("entity_count"), F.col("avg_confidence"), F.col("name")]
    ranked = batch.withColumn("_order", F.struct((-order[0]).alias("a"), (-order[1]).alias("b"), order[2].alias("c")))
    # a description seen under any name stays, as when the names are written one after the other
    told = ranked.groupBy("qid").agg(
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("_order"))).alias("told")
    )
    ranked = ranked.join(told, "qid").withColumn("description", F.coalesce("description", "told")).drop("told")
    merged = upsert_coalesce(concepts, ranked, ["qid"], ["_order"], ["url", "description"])
    named = batch.select(F.col("qid").alias("concept_id"), "name", "kind", "avg_confidence", "entity_count")
    links = map_concepts(named, entities)
    # the most frequent candidate is written first and keeps its score
    first = [-F.col("entity_count"), -F.col("score"), F.col("name")]
    new_bridge = insert_ignore(bridge, links, ["episode_id", "concept_id"], first)
    rows = claim_rows(found.select(F.col("qid").alias("concept_id"), "doc"), "concept_id")
    new_claims = claims.unionByName(rows).distinct()
    counts = candidates.agg(F.count(F.lit(1)).alias("candidates")).select(
        "candidates",
        batch.agg(F.count(F.lit(1))).scalar().alias("concepts_upserted"),
        (new_bridge.agg(F.count(F.lit(1))).scalar() - bridge.agg(F.count(F.lit(1))).scalar()).alias("episode_links_upserted"),
        (new_claims.agg(F.count(F.lit(1))).scalar() - claims.agg(F.count(F.lit(1))).scalar()).alias("claims_upserted"),
    )
    return {"concepts": merged, "episode_concepts": new_bridge, "concept_claims": new_claims, "counts": counts}
