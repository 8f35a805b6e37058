"""Row validation, schema-adaptive projection, fingerprints and dataset digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enum domains and fingerprint fields.
PLACE_KINDS = ("city", "region", "country", "unknown")
ENTITY_KINDS = ("person", "org", "event", "place", "unknown")
FINGERPRINT_FIELDS = {
    "episodes": ("id", "podcast_id", "title", "pub_date_iso", "kind", "narrator", "best_span_id", "best_place_id"),
    "spans": ("id", "episode_id", "start_iso", "end_iso", "precision", "qualifier", "score"),
    "places": ("id", "episode_id", "canonical_name", "norm_key", "place_kind", "lat", "lon"),
    "entities": ("id", "episode_id", "name", "kind", "confidence"),
    "clusters": ("id", "podcast_id", "k", "centroid_mid_year", "centroid_lat", "centroid_lon", "n_members", "label"),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    domain: tuple[str, ...] | None = None


def _fields(spec: str, **domains) -> tuple[Field, ...]:
    """``name:type`` words, ``!`` marks a required field."""
    out = []
    for word in spec.split():
        name, kind = word.split(":")
        out.append(Field(name, kind.rstrip("!"), kind.endswith("!"), domains.get(name)))
    return tuple(out)


# Exported row models.
MODELS = {
    "podcasts": _fields("id:bigint! title:string! link:string language:string description:string image_url:string"),
    "episodes": _fields(
        "id:bigint! podcast_id:bigint! title:string! pub_date_iso:string! page_url:string audio_url:string "
        "kind:string narrator:string description_pure:string best_span_id:bigint best_place_id:bigint"
    ),
    "spans": _fields(
        "id:bigint! episode_id:bigint! start_iso:string end_iso:string precision:string! qualifier:string! "
        "score:double! source_section:string! source_text:string! source_context:string"
    ),
    "places": _fields(
        "id:bigint! episode_id:bigint! canonical_name:string! norm_key:string! place_kind:string! "
        "lat:double lon:double radius_km:double",
        place_kind=PLACE_KINDS,
    ),
    "entities": _fields(
        "id:bigint! episode_id:bigint! name:string! kind:string! confidence:double! source_text:string!",
        kind=ENTITY_KINDS,
    ),
    "keywords": _fields("phrase:string! score:double!"),
    "clusters": _fields(
        "id:bigint! podcast_id:bigint! k:bigint! centroid_mid_year:double! centroid_lat:double! "
        "centroid_lon:double! n_members:bigint! label:string"
    ),
    "cluster_summaries": _fields("cluster_id:bigint! n_members:bigint!"),
    "cluster_stats": _fields(
        "cluster_id:bigint! episode_count:bigint! unique_podcast_count:bigint! dominant_podcast_share:double! "
        "median_pub_year:bigint temporal_span_years:bigint mean_span_confidence:double geo_dispersion:double "
        "cohesion_proxy:double"
    ),
    "cluster_term_metrics": _fields(
        "cluster_id:bigint! term:string! tfidf:double! support:bigint! global_support:bigint! lift:double! "
        "drop_impact:double!"
    ),
    "cluster_correlations": _fields(
        "cluster_a:bigint! cluster_b:bigint! jaccard_episode_overlap:double! cosine_term_similarity:double!"
    ),
    "cluster_timeline_histogram": _fields("cluster_id:bigint! start_year:bigint! end_year:bigint! count:bigint!"),
    "cluster_entity_stats": _fields("cluster_id:bigint! name:string! kind:string! count:bigint! lift:double!"),
    "cluster_place_stats": _fields(
        "cluster_id:bigint! canonical_name:string! count:bigint! lift:double! lat:double lon:double"
    ),
    "cluster_next_steps": _fields("cluster_id:bigint! title:string! rationale:string! action_type:string!"),
    "meta": _fields(
        "schema_version:string! generated_at_iso:string! source_db:string! dataset_revision:string! "
        "wiki_enriched:boolean! wikidata_enriched:boolean!"
    ),
}


def violations(columns: list[str], fields: tuple[Field, ...]) -> Column:
    """Array of ``field: problem`` texts; empty for a valid row."""
    problems = []
    for f in fields:
        if f.name not in columns:
            if f.required:
                problems.append(F.lit(f"{f.name}: missing"))
            continue
        c = F.col(f.name)
        if f.required:
            problems.append(F.when(c.isNull(), f"{f.name}: missing"))
        if f.type != "string":
            problems.append(F.when(c.isNotNull() & c.try_cast(f.type).isNull(), f"{f.name}: not {f.type}"))
        if f.domain:
            problems.append(F.when(c.isNotNull() & ~c.isin(*f.domain), f"{f.name}: not allowed"))
    return F.array_compact(F.array(*problems)).cast("array<string>")


def validate(df: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(typed valid rows, rows with their ``violations``)."""
    fields = MODELS[model]
    checked = df.withColumn("violations", violations(df.columns, fields))
    valid = checked.filter(F.size("violations") == 0).select(
        *[
            (F.col(f.name).try_cast(f.type) if f.name in df.columns else F.lit(None).cast(f.type)).alias(f.name)
            for f in fields
        ]
    )
    return valid, checked.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, model: str) -> DataFrame:
    return (
        df.select(F.explode(violations(df.columns, MODELS[model])).alias("violation"))
        .groupBy("violation")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def column_or_null(df: DataFrame, name: str, type_: str, *fallbacks: str) -> Column:
    """The first existing column of ``name`` and its fallbacks under that name, else typed NULL."""
    for candidate in (name, *fallbacks):
        if candidate in df.columns:
            return F.col(candidate).cast(type_).alias(name)
    return F.lit(None).cast(type_).alias(name)


# Older column names accepted for an episode table.
EPISODE_COLUMNS = (
    ("id", "bigint"),
    ("podcast_id", "string"),
    ("guid", "string"),
    ("page_url", "string"),
    ("title", "string"),
    ("pub_date", "timestamp_ntz", "published_at"),
    ("duration", "bigint", "duration_seconds"),
    ("audio_url", "string"),
    ("episode_type", "string"),
    ("kind", "string", "incident_type"),
    ("narrator", "string"),
    ("description_pure", "string", "description"),
    ("best_span_id", "string"),
    ("best_place_id", "string"),
)


def adaptive_episodes(df: DataFrame) -> DataFrame:
    return df.select(*[column_or_null(df, name, kind, *old) for name, kind, *old in EPISODE_COLUMNS])


def canonical_json(*fields: str, types: dict[str, str]) -> Column:
    """Compact JSON with sorted keys, NULLs kept and floats in fixed notation."""
    parts = []
    for name in sorted(fields):
        c = F.col(name)
        kind = types[name]
        if kind in ("double", "float"):
            # a decimal prints the same digits and costs less than a format call
            plain = (F.abs(c) < 1e15) & (c != 0)
            value = F.when(plain, c.cast("decimal(38,6)").cast("string")).otherwise(F.format_string("%.6f", c))
        elif kind in ("bigint", "int", "smallint", "tinyint", "boolean"):
            value = c.cast("string")
        else:
            text = c.cast("string")
            quoted = F.to_json(F.struct(text.alias("x")))  # {"x":"..."}, control characters escaped
            escaped = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
            value = F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
        parts.append(F.concat(F.lit(f'"{name}":'), F.when(c.isNull(), "null").otherwise(value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def row_fingerprint(df: DataFrame, fields: tuple[str, ...]) -> Column:
    return F.sha2(canonical_json(*fields, types=dict(df.dtypes)), 256)


# Words of 64 bits in a row fingerprint.
WORDS = 4


def digest_state(df: DataFrame, fingerprint: str = "row_fingerprint") -> DataFrame:
    """One row that states of other rows can be added to or taken from: row count, and the sum and
    exclusive or of each 64-bit word of the row fingerprints.

    A word is read once, as a signed number.  Its halves are added as whole numbers within a task,
    which can't overflow, and as decimals over the tasks.
    """
    words = df.select(*[F.conv(F.substring(fingerprint, 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"w{i}") for i in range(WORDS)])
    halves = [(f"h{i}", F.shiftrightunsigned(f"w{i}", 32)) for i in range(WORDS)]
    halves += [(f"l{i}", F.col(f"w{i}").bitwiseAND(F.lit(0xFFFFFFFF))) for i in range(WORDS)]
    tasks = words.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in halves], *[F.bit_xor(f"w{i}").alias(f"x{i}") for i in range(WORDS)]
    )

    def whole(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("decimal(19,0)")), F.lit(0))

    sums = [(whole(f"h{i}") * F.lit(2**32).cast("decimal(10,0)") + whole(f"l{i}")).cast("decimal(38,0)").alias(f"sum{i}") for i in range(WORDS)]
    ors = [F.coalesce(F.bit_xor(f"x{i}"), F.lit(0).cast("bigint")).alias(f"xor{i}") for i in range(WORDS)]
    return tasks.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("row_count"), *sums, *ors)


def updated_state(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``state`` after rows with the states ``added`` came and those of ``removed`` went.

    A changed row is removed with its old fingerprint and added with its new one, so a batch of
    changes updates the digest of a table without reading the table.
    """
    out = state.withColumn("sign", F.lit(1))
    for other, sign in ((added, 1), (removed, -1)):
        if other is not None:
            out = out.unionByName(other.withColumn("sign", F.lit(sign)))
    return out.agg(
        F.sum(F.col("row_count") * F.col("sign")).alias("row_count"),
        *[F.sum(F.col(f"sum{i}") * F.col("sign")).cast("decimal(38,0)").alias(f"sum{i}") for i in range(WORDS)],
        *[F.bit_xor(f"xor{i}").alias(f"xor{i}") for i in range(WORDS)],
    )


def digest_of(state: DataFrame) -> DataFrame:
    """(row_count, digest) of a state."""
    sums = [F.col(f"sum{i}").cast("string") for i in range(WORDS)]
    ors = [F.lpad(F.lower(F.hex(f"xor{i}")), 16, "0") for i in range(WORDS)]
    return state.select("row_count", F.concat_ws("-", *sums, *ors).alias("digest"))


def dataset_digest(df: DataFrame, fingerprint: str = "row_fingerprint") -> DataFrame:
    """Order-free digest: row count, and the sums and exclusive ors of the four 64-bit words of the
    row fingerprints."""
    return digest_of(digest_state(df, fingerprint))
