"""Queries over the nested entries (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexichron.operators import nested
from lexichron.session import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.canonical(table(spark, sf_dir, "entries_df"), table(spark, sf_dir, "entries_raw"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author and affiliation borne; position 0 for authors without one."""
    return nested.link_table(_entries(spark, sf_dir), keep_unlinked=True)


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_entries(spark, sf_dir))["entries"].drop("harvested_at")


def p4_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_entries(spark, sf_dir))["authors"]


def p4_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_entries(spark, sf_dir))["affiliations"]


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_entries(spark, sf_dir))["links"]


_NESTED = """
raw0 AS (
  SELECT entry_id, harvested_at, payload::JSON AS v FROM entries_raw WHERE payload IS NOT NULL AND json_valid(payload)
), raw1 AS (
  SELECT entry_id, harvested_at,
    coalesce(v->'search-results'->'entry', v->'entry', v) AS v FROM raw0
), raw2 AS (
  SELECT entry_id, harvested_at, CASE WHEN json_type(v) = 'ARRAY' THEN v->0 ELSE v END AS e FROM raw1
), raw3 AS (
  SELECT entry_id, harvested_at, e->>'eid' AS eid, e->>'dc:title' AS title, e->>'dc:creator' AS creator,
    TRY_CAST(coalesce(e->'author-count'->>'@total', e->>'author-count') AS INTEGER) AS declared_authors,
    CASE json_type(e->'author') WHEN 'ARRAY' THEN CAST(e->'author' AS JSON[])
      WHEN 'OBJECT' THEN [e->'author'] END AS a,
    CASE json_type(e->'affiliation') WHEN 'ARRAY' THEN CAST(e->'affiliation' AS JSON[])
      WHEN 'OBJECT' THEN [e->'affiliation'] END AS f
  FROM raw2
), raw4 AS (
  SELECT entry_id, harvested_at, eid, title, creator, declared_authors,
    list_transform(a, lambda x: CASE WHEN x IS NULL OR json_type(x) = 'NULL' THEN NULL ELSE {
      'seq': x->>'@seq', 'name': x->>'authname',
      'afids': list_transform(CASE json_type(x->'afid') WHEN 'ARRAY' THEN CAST(x->'afid' AS JSON[])
          WHEN 'NULL' THEN NULL ELSE [x->'afid'] END,
        lambda y: CASE json_type(y) WHEN 'OBJECT' THEN y->>'$."$"' WHEN 'NULL' THEN NULL ELSE y->>'$' END)} END) AS author,
    list_transform(f, lambda x: CASE WHEN x IS NULL OR json_type(x) = 'NULL' THEN NULL ELSE {
      'afid': x->>'afid', 'name': x->>'affilname', 'city': x->>'affiliation-city',
      'country': x->>'affiliation-country'} END) AS affiliation
  FROM raw3
), typed AS (
  SELECT entry_id, harvested_at, eid, "dc:title" AS title, "dc:creator" AS creator,
    TRY_CAST("author-count"."@total" AS INTEGER) AS declared_authors,
    list_transform(author, lambda x: CASE WHEN x IS NULL THEN NULL ELSE {
      'seq': x."@seq", 'name': x.authname, 'afids': list_transform(x.afid, lambda y: y."$")} END) AS author,
    list_transform(affiliation, lambda x: CASE WHEN x IS NULL THEN NULL ELSE {
      'afid': x.afid, 'name': x.affilname, 'city': x."affiliation-city",
      'country': x."affiliation-country"} END) AS affiliation
  FROM entries_df
), latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY harvested_at DESC NULLS LAST) AS rn
    FROM (SELECT * FROM typed UNION ALL BY NAME SELECT * FROM raw4))
  WHERE rn = 1
), authors AS (
  SELECT entry_id, affiliation, unnest(author) AS a, unnest(range(1, len(author) + 1)) AS author_pos FROM latest
), affiliations AS (
  SELECT entry_id, unnest(affiliation) AS f, unnest(range(1, len(affiliation) + 1)) AS affil_pos FROM latest
), first_pos AS (
  SELECT entry_id, f.afid AS afid, min(affil_pos) AS affil_pos FROM affiliations WHERE f.afid IS NOT NULL GROUP BY 1, 2
), borne AS (
  SELECT DISTINCT entry_id, author_pos, afid
  FROM (SELECT entry_id, author_pos, unnest(a.afids) AS afid FROM authors WHERE a IS NOT NULL) WHERE afid IS NOT NULL
), links AS (
  SELECT b.entry_id, b.author_pos, p.affil_pos FROM borne b JOIN first_pos p USING (entry_id, afid)
)
"""

QUERIES = {
    "p4_found": p4_found,
    "p4_entries": p4_entries,
    "p4_authors": p4_authors,
    "p4_affiliations": p4_affiliations,
    "p4_links": p4_links,
}

SQL = {
    "p4_found": f"""WITH {_NESTED}
SELECT a.entry_id, a.author_pos::BIGINT AS author_pos, coalesce(l.affil_pos, 0)::BIGINT AS affil_pos
FROM authors a LEFT JOIN links l ON l.entry_id = a.entry_id AND l.author_pos = a.author_pos WHERE a.a IS NOT NULL""",
    "p4_entries": f"""WITH {_NESTED}
SELECT entry_id, eid, title, creator, declared_authors,
  len(list_filter(coalesce(author, []), lambda x: x IS NOT NULL))::INTEGER AS n_authors,
  len(list_filter(coalesce(affiliation, []), lambda x: x IS NOT NULL))::INTEGER AS n_affiliations FROM latest""",
    "p4_authors": f"""WITH {_NESTED}
SELECT entry_id, author_pos::BIGINT AS author_pos, a.seq AS seq, a.name AS name FROM authors WHERE a IS NOT NULL""",
    "p4_affiliations": f"""WITH {_NESTED}
SELECT entry_id, affil_pos::BIGINT AS affil_pos, f.afid AS afid, f.name AS name, f.city AS city, f.country AS country
FROM affiliations WHERE f IS NOT NULL""",
    "p4_links": f"""WITH {_NESTED}
SELECT entry_id, author_pos::BIGINT AS author_pos, affil_pos::BIGINT AS affil_pos FROM links""",
}
