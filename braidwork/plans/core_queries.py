"""Queries of the general operators for large reshaping and hierarchy jobs, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import wide as Wd
from ..session import materialize
from .tables import table


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return Wd.wide_table(table(spark, sf, "sampled_triples"), table(spark, sf, "relation_types"), table(spark, sf, "placeholder_values"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return Wd.filled_cells(_wide(spark, sf), Wd.attribute_schema(table(spark, sf, "relation_types")))


def p1_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf)


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by the kind of the table they are in."""
    schema = Wd.attribute_schema(table(spark, sf, "relation_types"))
    cells = Wd.attribute_cells(table(spark, sf, "sampled_triples"), schema, table(spark, sf, "placeholder_values"), ("POL", "CLM", "SRV", "CHAT", "EMAIL"))
    return Wd.set_coverage(materialize(Wd.attribute_sets(cells, schema), "attribute-sets"), Wd.FREQUENT, len(schema))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return H.hierarchy(*H.parent_links(table(spark, sf, "taxonomy_nodes"), table(spark, sf, "class_hierarchy")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select("node_id", "root_id", "depth", "path")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).select("node_id", (F.col("last") - F.col("first")).alias("n_descendants"))


def p5_descendant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with each of its descendants, of which p5_descendants has the number."""
    return H.descendants(_tree(spark, sf))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p1_tables": p1_tables, "p5_found": p5_found, "p5_descendants": p5_descendants, "p5_descendant_pairs": p5_descendant_pairs}

_SPACE = r"[\s\p{Z}\p{Cf}]"
_N = r"(?:\d+|\d{1,3}(?:,\d{3})+)"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _month(c: str) -> str:
    return f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', {c}) + 2) // 3 AS VARCHAR)"


CELLS = rf"""rows_ AS (SELECT upper(regexp_replace(subject, '[^\p{{L}}\p{{N}}]', '', 'g')) AS s, lower(regexp_replace(relation, '[^\p{{L}}\p{{N}}]', '', 'g')) AS k,
    trim(regexp_replace(object, '{_SPACE}+', ' ', 'g'), ' ') AS o, extracted_at, ingested_at, seq FROM sampled_triples WHERE object IS NOT NULL),
  typed AS (SELECT regexp_extract(s, '^(POL|CLM|SRV|CHAT|EMAIL)') || '-' || lower(s[-12:]) AS subject, t.relation, value_type, o, lower(o) AS l, extracted_at, ingested_at, seq FROM rows_
    JOIN relation_types t ON lower(regexp_replace(t.relation, '_', '', 'g')) = k WHERE regexp_matches(s, '^(POL|CLM|SRV|CHAT|EMAIL)[0-9A-F]{{12}}$') AND lower(o) NOT IN (SELECT lower(marker) FROM placeholder_values)),
  parsed AS (SELECT *, CASE value_type
    WHEN 'date' THEN CAST(TRY_CAST(CASE WHEN regexp_matches(l, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}([t ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(z|[+-]\d{{2}}:?\d{{2}})?)?$') THEN regexp_extract(l, '^[\d-]+') WHEN regexp_matches(l, '^\d{{4}}/\d{{1,2}}/\d{{1,2}}$') THEN replace(l, '/', '-')
      WHEN regexp_matches(l, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN regexp_replace(l, '^(\d+)/(\d+)/(\d+)$', '\3-\1-\2') WHEN regexp_matches(l, '^\d{{8}}$') THEN l[1:4] || '-' || l[5:6] || '-' || l[7:8]
      WHEN regexp_matches(l, '^\d{{1,2}} {_MON}\.?,? \d{{4}}$') THEN l[-4:] || '-' || {_month(f"regexp_extract(l, '{_MON}', 1)")} || '-' || regexp_extract(l, '^(\d+)', 1)
      WHEN regexp_matches(l, '^{_MON}\.? \d{{1,2}},? \d{{4}}$') THEN l[-4:] || '-' || {_month(f"regexp_extract(l, '{_MON}', 1)")} || '-' || regexp_extract(l, ' (\d{{1,2}}),? ', 1) END AS DATE) AS VARCHAR)
    WHEN 'decimal' THEN CASE WHEN regexp_matches(regexp_replace(l, '^usd ?| ?usd$', '', 'g'), '^[-+]? ?\$? ?{_N}(?:\.\d+)?$') THEN CAST(CAST(regexp_replace(l, '[^\d.\-]', '', 'g') AS DECIMAL(28,2)) AS VARCHAR) END
    WHEN 'percent' THEN CASE WHEN regexp_matches(l, '^[-+]?{_N}(?:\.\d+)? ?(?:%|pct|percent)$') THEN CAST(CAST(regexp_extract(l, '^-?[\d.]+') AS DECIMAL(28,2)) AS VARCHAR) END
    WHEN 'integer' THEN CASE WHEN regexp_matches(l, '^[-+]?{_N}(?:\.0+)?$') THEN CAST(TRY_CAST(regexp_replace(regexp_replace(l, '\.0+$', ''), '[,+]', '', 'g') AS BIGINT) AS VARCHAR) END
    WHEN 'boolean' THEN CASE WHEN l IN ('true', 'yes', 'y', '1') THEN 'true' WHEN l IN ('false', 'no', 'n', '0') THEN 'false' END
    ELSE nullif(lower(regexp_replace(o, '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')), '') END AS value FROM typed),
  best AS (SELECT subject, relation, value_type, max({{'e': extracted_at, 'i': ingested_at, 's': seq, 'v': value}}).v AS value, max({{'e': extracted_at, 'i': ingested_at, 's': seq, 'o': o}}).o AS o FROM parsed WHERE value IS NOT NULL GROUP BY ALL)"""

#: The columns of relation_types by type, which SQL must name.
_COLUMNS = {
    "DECIMAL(28,2)": "AMOUNT_PAID_ON_BUILDING_CLAIM AMOUNT_PAID_ON_CONTENTS_CLAIM BASE_ELEVATION_DIFFERENCE NET_ADJUSTMENT REFUND_OFFERED TOTAL_BUILDING_INSURANCE_COVERAGE TOTAL_CONTENTS_INSURANCE_COVERAGE TOTAL_INSURANCE_PREMIUM BUILDING_LOSS_SHARE DEDUCTIBLE_RATE RESPONSE_RATE",
    "BIGINT": "ATTACHMENT_COUNT EASE_OF_CLAIM_CES MESSAGE_COUNT NUMBER_OF_FLOORS OVERALL_CSAT POLICY_COUNT WATER_DEPTH",
    "DATE": "CHAT_STARTED_DATE CLAIM_FILED_DATE DATE_OF_LOSS ORIGINAL_CONSTRUCTION_DATE POLICY_EFFECTIVE_DATE POLICY_TERMINATION_DATE SENT_DATE SURVEY_COMPLETED_DATE",
    "BOOLEAN": "ELEVATED_BUILDING_INDICATOR PRIMARY_RESIDENCE_INDICATOR RESOLVED_INDICATOR TOTAL_LOSS_INDICATOR URGENT_INDICATOR WOULD_RECOMMEND",
    "VARCHAR": "CAUSE_OF_DAMAGE CLAIM_STATUS FLOOD_ZONE_AT_LOSS PROPERTY_STATE RATED_FLOOD_ZONE REPORTED_CITY REPORTED_ZIP_CODE SURVEY_WAVE TOPIC INSURED_CONTACT LOSS_LOCATION PROPERTY_ADDRESS RESPONDENT_CONTACT",
}
_RIDERS = {"LIMIT": "DECIMAL(28,2)", "CODE": "VARCHAR", "START_DATE": "DATE"}


def _wide_columns() -> list[tuple[str, str]]:
    plain = [(f"HAS_{c}", t) for t, names in _COLUMNS.items() for c in names.split()]
    return plain + [(f"HAS_ENDORSEMENT_{k}_{c}", t) for k in ("BOAT", "EARTHQUAKE", "JEWELRY", "PET", "SOLAR", "SUMP") for c, t in _RIDERS.items()]


UP = r"""own AS (SELECT node_id AS id, run_id, max({'u': updated_at, 'n': name}).n AS name, lower(regexp_replace(max(name), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS k FROM taxonomy_nodes GROUP BY node_id, run_id),
  pairs AS (SELECT run_id, lower(regexp_replace(name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS c, lower(regexp_replace(parent, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS p FROM taxonomy_nodes WHERE parent IS NOT NULL
    UNION SELECT run_id, lower(regexp_replace(child, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lower(regexp_replace(parent, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) FROM class_hierarchy WHERE edge_type = 'SUBCLASS_OF'),
  up AS (SELECT x.id, min(y.id) AS parent FROM pairs JOIN own x ON x.run_id = pairs.run_id AND x.k = c JOIN own y ON y.run_id = pairs.run_id AND y.k = p GROUP BY x.id),
  tree AS (SELECT own.id, own.id AS root_id, 0 AS depth, own.name AS path FROM own LEFT JOIN up USING (id) WHERE parent IS NULL
    UNION ALL SELECT up.id, tree.root_id, tree.depth + 1, tree.path || ' > ' || own.name FROM tree JOIN up ON up.parent = tree.id JOIN own ON own.id = up.id)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {CELLS} SELECT subject, relation, value FROM best WHERE value_type <> 'parts'",
    "p1_wide": f"WITH {CELLS} SELECT subject, split_part(subject, '-', 1) AS record_type, "
    + ", ".join(f"CAST(max({'o' if t == 'VARCHAR' else 'value'}) FILTER (relation = '{c}') AS {t}) AS {c}" for c, t in _wide_columns()) + " FROM best GROUP BY subject",
    "p5_found": f"WITH RECURSIVE {UP} SELECT own.id AS node_id, coalesce(root_id, -1) AS root_id, coalesce(depth, -1) AS depth, coalesce(path, '') AS path FROM own LEFT JOIN tree USING (id)",
    "p5_descendants": f"""WITH RECURSIVE {UP}, below AS (SELECT tree.id AS a, tree.id AS d FROM tree UNION ALL SELECT below.a, up.id FROM below JOIN up ON up.parent = below.d)
        SELECT own.id AS node_id, CASE WHEN tree.id IS NOT NULL THEN n - 1 END AS n_descendants FROM own LEFT JOIN tree USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM below GROUP BY a) USING (id)""",
    "p5_descendant_pairs": f"""WITH RECURSIVE {UP}, below AS (SELECT tree.id AS ancestor_id, tree.id AS node_id, 0 AS distance FROM tree UNION ALL SELECT below.ancestor_id, up.id, below.distance + 1 FROM below JOIN up ON up.parent = below.node_id)
        SELECT * FROM below WHERE distance > 0""",
}
