"""Meta data of an export."""

from collections import Counter

from chronoweave.operators import metrics
from chronoweave.plans import export_dataset

ENTITIES = "id long, episode_id long, name string, kind string, confidence double"


def revision(spark, rows, parts, **more):
    made = spark.createDataFrame(rows, ENTITIES).repartition(parts)
    sections = {"entities": export_dataset.with_fingerprint(made, "entities"), "podcasts": spark.range(3)} | more
    meta = export_dataset.export_meta(sections, "here").collect()
    assert len(meta) == 1 and meta[0].source_db == "here" and meta[0].schema_version == export_dataset.SCHEMA_VERSION
    return meta[0]


def test_revision_follows_the_content_only(spark):
    rows = [(i, i % 3, f"n{i}", "person" if i % 2 else None, i / 7) for i in range(30)]
    first = revision(spark, rows, 1)
    assert revision(spark, rows[::-1], 4).dataset_revision == first.dataset_revision
    assert revision(spark, rows[:-1], 2).dataset_revision != first.dataset_revision
    assert revision(spark, rows[:-1] + [(29, 2, "n29", "person", 0.5)], 2).dataset_revision != first.dataset_revision
    assert not first.wiki_enriched and not first.wikidata_enriched
    assert len(first.dataset_revision) == 64 and first.generated_at_iso is not None


def test_enrichment_flags(spark):
    got = revision(spark, [], 1, concepts=spark.range(1), concept_claims=spark.range(1))
    assert got.wiki_enriched and got.wikidata_enriched


def test_facts_are_counted_without_a_shuffle_of_their_own(spark):
    """Names and years per cluster as by hand; facts go to the join at most, not to a count per episode before."""
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 11), (3, 12)], "cluster_id long, episode_id long")
    facts = [(10, "a", "x"), (10, "a", "x"), (11, "a", "x"), (11, "b", None), (12, None, "y"), (13, "a", "x")]
    got = metrics._counts(members, spark.createDataFrame(facts, "episode_id long, name string, kind string"), ["name", "kind"])
    assert Counter(tuple(r) for r in got.collect()) == Counter(
        [(1, "a", "x", 3), (1, "b", None, 1), (2, "a", "x", 2), (2, "b", None, 2), (3, None, "y", 1)]
    )
    dates = [(10, "1914-07-01", "1918-11-11"), (10, "1915-01-01", None), (11, None, "1923-01-01"), (12, None, None)]
    spans = spark.createDataFrame(dates, "episode_id long, start_date string, end_date string").selectExpr("episode_id", "date(start_date) AS start_date", "date(end_date) AS end_date")
    bins = metrics.timeline_histogram(members, spans)
    assert Counter(tuple(r) for r in bins.collect()) == Counter([(1, 1910, 1919, 3), (1, 1920, 1929, 1), (2, 1920, 1929, 2)])
    for df in (got, bins):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
