"""Person lists and typed entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_any, find_all

# Patterns, stop words and confidences.
LABEL_PATTERN = r"(?iU)\b(Personen|Person|Guests|Guest|Mitwirkende)\b\s*:?"
NAME_PATTERN = (
    r"(?U)(?=[A-ZÄÖÜ])\b([A-ZÄÖÜ][a-zäöüß]+\s+(?:(?:von|van|de|del|der|den|da|di)\s+)?"
    r"[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+){0,2})\b"
)
NAME_STOP = (
    "Ort",
    "Zeit",
    "Thema",
    "Personen",
    "Kontext",
    "Mehr",
    "Folge",
    "Jahr",
    "Krieg",
    "Revolution",
    "Politik",
    "Frankreich",
    "Deutschland",
)
PERSON_PATTERN = (
    r"(?U)(?=[A-ZÄÖÜ])\b([A-ZÄÖÜ][a-zäöüß]+(?:\s+(?:von|der|de|del|da|di))?\s+[A-ZÄÖÜ][a-zäöüß]+)\b"
)
ORG_PATTERN = (
    r"(?U)(?=[A-ZÄÖÜ])\b([A-ZÄÖÜ][\wÄÖÜäöüß\- ]{2,}\b"
    r"(?:GmbH|AG|Universität|University|Institut|Stiftung|Bundestag|KPdSU|CDU|CSU|NSDAP|KPD|SPD))\b"
)
EVENT_PATTERN = (
    r"(?U)(?=[SRGAP])\b(Schlacht\s+von\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+|Revolution\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+"
    r"|Gründung\s+der\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+|Attentat\s+auf\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+"
    r"|Parteitag\s+der\s+[A-ZÄÖÜ][\wÄÖÜäöüß\-]+)\b"
)
EVENT_WORDS = ("Schlacht", "Revolution", "Gründung", "Attentat", "Parteitag")
ORG_WORDS = (
    "GmbH",
    "AG",
    "Universität",
    "University",
    "Institut",
    "Stiftung",
    "Bundestag",
    "KPdSU",
    "CDU",
    "CSU",
    "NSDAP",
    "KPD",
    "SPD",
)
INSTITUTION_WORDS = ("Universität", "University", "Institut", "Stiftung")
EVENT_CONFIDENCE, ORG_CONFIDENCE, PERSON_CONFIDENCE = 0.85, 0.80, 0.65


def person_names(text: Column) -> Column:
    """Distinct capitalised names in text order, label words cut out first."""
    names = find_all(F.regexp_replace(text, LABEL_PATTERN, " "), NAME_PATTERN, 1)
    stop = F.array(*[F.lit(w) for w in NAME_STOP])
    return F.array_distinct(
        F.filter(names, lambda n: ~F.arrays_overlap(F.split(n, r"(?U)\s+"), stop))
    )


def entity_array(segment: Column) -> Column:
    """Events, organisations and persons in that order, one entry per (name, kind)."""

    def squeeze(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)\s+", " ")

    def tag(names: Column, kind: str, confidence: float) -> Column:
        return F.transform(
            F.array_distinct(names),
            lambda n: F.struct(
                n.alias("name"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")
            ),
        )

    def scan_if(words, pattern: str) -> Column:
        """Backtracking patterns run only on text that holds one of their fixed words."""
        none = F.array().cast("array<string>")
        return F.when(contains_any(segment, words), find_all(segment, pattern, 1)).otherwise(none)

    events = scan_if(EVENT_WORDS, EVENT_PATTERN)
    orgs = F.transform(scan_if(ORG_WORDS, ORG_PATTERN), squeeze)
    persons = F.filter(
        F.transform(find_all(segment, PERSON_PATTERN, 1), squeeze),
        lambda n: ~contains_any(n, INSTITUTION_WORDS),
    )
    return F.concat(
        tag(events, "event", EVENT_CONFIDENCE),
        tag(orgs, "org", ORG_CONFIDENCE),
        tag(persons, "person", PERSON_CONFIDENCE),
    )


def extract_entities(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return segments.select(*keys, F.posexplode(entity_array(F.col(text))).alias("entity_pos", "e")).select(
        *keys, "entity_pos", "e.*", F.col("e.name").alias("source_text")
    )
