"""Assembly of the exported dataset sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import ClusterInputs, cluster_metric_bundle, member_counts
from ..operators.quality import FINGERPRINT_FIELDS, digest_of, digest_state, row_fingerprint
from ..operators.relational import last_per, top_n

SCHEMA_VERSION = "2026-02-27"


def with_fingerprint(df: DataFrame, section: str) -> DataFrame:
    return df.withColumn("row_fingerprint", row_fingerprint(df, FINGERPRINT_FIELDS[section]))


def join_place_names(places: DataFrame, places_norm: DataFrame) -> DataFrame:
    """Places with canonical name, key and kind; the raw name stands in where no norm row exists."""
    dim = places_norm.select(
        "place_norm_id",
        F.col("canonical_name").alias("n_name"),
        F.col("norm_key").alias("n_key"),
        F.col("place_kind").alias("n_kind"),
    )
    joined = places.join(dim, "place_norm_id", "left")
    kind = F.coalesce(F.nullif(F.coalesce("n_kind", "place_kind"), F.lit("")), F.lit("unknown"))
    return joined.select(
        "place_id",
        "episode_id",
        F.coalesce("n_name", "name_raw").alias("canonical_name"),
        F.coalesce("n_key", F.lower("name_raw")).alias("norm_key"),
        kind.alias("place_kind"),
        "lat",
        "lon",
    )


def join_keyword_phrases(bridge: DataFrame, keywords: DataFrame) -> DataFrame:
    """Bridge rows with their phrase; rows without one drop out."""
    dim = keywords.filter("phrase IS NOT NULL AND phrase <> ''")
    return bridge.join(dim, "keyword_id").select("episode_id", "phrase", "score")


def nested_keywords(bridge: DataFrame) -> DataFrame:
    """One row per episode with its keywords, best first; an episode owns a bounded number."""
    entry = F.struct((-F.col("score")).alias("neg"), "phrase", "score")
    sorted_ = F.array_sort(F.collect_list(entry))
    return bridge.groupBy("episode_id").agg(sorted_.alias("k")).select(
        "episode_id", F.transform("k", lambda e: F.struct(e["phrase"].alias("phrase"), e["score"].alias("score"))).alias("keywords")
    )


def cluster_summaries(clusters: DataFrame, membership: DataFrame, keywords: DataFrame, entities: DataFrame, n: int = 25) -> DataFrame:
    """Clusters with member count (counted when missing), top keywords and entities."""
    counted = member_counts(membership).withColumnRenamed("n_members", "counted")
    kw = top_n(keywords, ["cluster_id"], [F.desc("score"), F.asc("phrase")], n, "r").groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "phrase", "score"))).alias("top_keywords")
    )
    en = top_n(entities, ["cluster_id"], [F.desc("count"), F.asc("name"), F.asc("kind")], n, "r").groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "name", "kind", "count"))).alias("top_entities")
    )
    base = clusters if "n_members" in clusters.columns else clusters.withColumn("n_members", F.lit(None).cast("bigint"))
    out = base.join(counted, "cluster_id", "left").withColumn("n_members", F.coalesce("n_members", "counted", F.lit(0))).drop("counted")
    return out.join(kw, "cluster_id", "left").join(en, "cluster_id", "left")


def export_sections(tables: dict[str, DataFrame], x: ClusterInputs, place_order: list[str]) -> dict[str, DataFrame]:
    """Base sections, the seven metric sections, and the concept sections that exist."""
    sections = {
        "podcasts": tables["podcasts"].orderBy("id"),
        "episodes": with_fingerprint(tables["episodes"], "episodes").orderBy("podcast_id", "pub_date_iso", "id"),
        "spans": with_fingerprint(tables["spans"], "spans"),
        "places": with_fingerprint(tables["places"], "places"),
        "entities": with_fingerprint(tables["entities"], "entities"),
        "episode_keywords": nested_keywords(x.keywords),
        "episode_clusters": last_per(x.membership.withColumn("seq", F.col("cluster_id")), ["episode_id"], ["seq"]).drop("seq"),
        "clusters": cluster_summaries(
            tables["clusters"], x.membership, tables["cluster_keywords"], tables["cluster_entities"]
        ),
    }
    sections |= cluster_metric_bundle(x, place_order)
    for name in ("concepts", "episode_concepts", "concept_claims"):
        if name in tables:
            sections[name] = tables[name]
    return sections


def dataset_revision(sections: dict[str, DataFrame]) -> DataFrame:
    """(row_count, digest) over the fingerprinted rows of all sections; see ``quality.digest_state``."""
    rows = None
    for df in sections.values():
        if "row_fingerprint" in df.columns:
            one = df.select("row_fingerprint")
            rows = one if rows is None else rows.unionByName(one)
    return digest_of(digest_state(rows))


def export_meta(sections: dict[str, DataFrame], source: str) -> DataFrame:
    """One row that describes an export.  ``dataset_revision`` is the hash of the digest of its rows, so
    it is the same for the same content, whatever the order, the files and the time of the export."""
    revision = dataset_revision(sections)
    return revision.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.current_timestamp().alias("generated_at_iso"),
        F.lit(source).alias("source_db"),
        F.sha2(F.concat_ws(":", "row_count", "digest"), 256).alias("dataset_revision"),
        F.lit("concepts" in sections).alias("wiki_enriched"),
        F.lit("concept_claims" in sections).alias("wikidata_enriched"),
    )


def export_dataset(tables: dict[str, DataFrame], x: ClusterInputs, place_order: list[str], source: str) -> dict[str, DataFrame]:
    """The complete export: ``meta`` first, then all sections."""
    sections = export_sections(tables, x, place_order)
    return {"meta": export_meta(sections, source)} | sections


def section_counts(sections: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sections.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("section"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["dataset_revision", "export_dataset", "export_meta", "export_sections", "join_keyword_phrases", "join_place_names", "nested_keywords", "section_counts"]
