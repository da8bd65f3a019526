"""Oracle SQL per query (DuckDB dialect)."""

from __future__ import annotations

from fundlens.plans.oracle_views import (
    ORDER,
    ORGANIZATIONS,
    PROJECTS,
    PUBLICATIONS,
    SCORED,
    VOCABULARY,
)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _bucket(col: str) -> str:
    return (
        f"CASE WHEN {col}<100000 THEN 0 WHEN {col}<500000 THEN 1 WHEN {col}<1000000 THEN 2 "
        f"WHEN {col}<5000000 THEN 3 WHEN {col}<10000000 THEN 4 ELSE 5 END"
    )


_LABELS = "['<100 K','100 K–500 K','500 K–1 M','1 M–5 M','5 M–10 M','≥10 M']"


def _hist(col: str) -> str:
    return (
        _with(PROJECTS)
        + f", b AS (SELECT {_bucket(col)} AS pos FROM projects) "
        + f"SELECT pos, {_LABELS}[pos+1] AS label, count(*) AS value FROM b GROUP BY pos"
    )


def _top(measure: str) -> str:
    return (
        f"SELECT label, value FROM (SELECT label, {measure} AS value, m FROM agg "
        "ORDER BY m DESC, label ASC NULLS LAST LIMIT 10) WHERE label IS NOT NULL"
    )


def _listed(projects: str = "projects") -> str:
    """Project-child pairs of the two exploded charts; a project without children gives a null."""
    return (
        f"tv AS (SELECT p.id, p.ecMaxContribution, v.euroSciVocTitle AS label FROM {projects} p "
        "LEFT JOIN vocabulary v ON v.projectID=p.id),"
        f"tc AS (SELECT p.id, o.country AS label FROM {projects} p "
        "LEFT JOIN organizations o ON o.projectID=p.id)"
    )


def _series(where: str) -> str:
    top = (
        "SELECT chart, row_number() OVER (PARTITION BY chart ORDER BY m DESC, label ASC NULLS LAST) AS pos, "
        "label, m FROM ranked"
    )
    return (
        _with(PROJECTS, ORGANIZATIONS, VOCABULARY)
        + f", f AS (SELECT * FROM projects p WHERE {where}), "
        + _listed("f")
        + f""", b AS (
  SELECT 'ppy' AS chart, year(startDate) AS pos, CAST(year(startDate) AS VARCHAR) AS label, count(*)*1.0::DOUBLE AS value
    FROM f WHERE startDate IS NOT NULL GROUP BY 1,2,3
  UNION ALL SELECT 'psd', pos, {_LABELS}[pos+1], count(*) FROM (SELECT {_bucket('totalCost')} AS pos FROM f) GROUP BY 2
  UNION ALL SELECT 'frb', pos, {_LABELS}[pos+1], count(*) FROM (SELECT {_bucket('ecMaxContribution')} AS pos FROM f) GROUP BY 2),
ranked AS (
  SELECT 'frs' AS chart, fundingScheme AS label, count(*)::DOUBLE AS m FROM f GROUP BY 2
  UNION ALL SELECT 'top10', label, coalesce(sum(ecMaxContribution),0) FROM tv GROUP BY 2
  UNION ALL SELECT 'ppc', label, count(*) FROM tc GROUP BY 2)
SELECT chart, CAST(pos AS INT) AS pos, label, value FROM b
UNION ALL
SELECT chart, CAST(pos AS INT), label, CASE WHEN chart='top10' THEN round(m/1e6,1) ELSE m END
FROM ({top}) WHERE pos<=10 AND label IS NOT NULL"""
    )


_HAS_COUNTRY = "EXISTS (SELECT 1 FROM organizations o WHERE o.projectID=p.id AND o.country='{}')"
_HAS_ORG = "EXISTS (SELECT 1 FROM organizations o WHERE o.projectID=p.id AND o.name='{}')"
_HAS_TOPIC = "EXISTS (SELECT 1 FROM vocabulary v WHERE v.projectID=p.id AND v.euroSciVocTitle='{}')"


_DAYS = "datediff('day', startDate, endDate)"


def _page(where: str, order: str, limit: int = 10, offset: int = 0) -> str:
    pairs = ", ".join(
        f"CASE WHEN top{i}_feature IS NOT NULL AND top{i}_shap IS NOT NULL "
        f"THEN top{i}_feature || '=' || CAST(round(top{i}_shap*100) AS BIGINT) END"
        for i in range(1, 7)
    )
    return (
        _with(PROJECTS, SCORED, ORGANIZATIONS, VOCABULARY, PUBLICATIONS)
        + f""", pg AS (SELECT * FROM scored p WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}),
v AS (SELECT projectID, string_agg(euroSciVocTitle, '|' ORDER BY {ORDER}) AS titles,
        string_agg(euroSciVocPath, '|' ORDER BY {ORDER}) AS paths FROM vocabulary GROUP BY 1),
c AS (SELECT projectID, coalesce(isPublishedAs, 'null') AS t, count(*) AS n FROM publications GROUP BY 1,2),
k AS (SELECT projectID, string_agg(t || ':' || n, ',' ORDER BY t) AS publications FROM c GROUP BY 1)
SELECT id, title, status, strftime(startDate, '%Y-%m-%d') AS startDate,
  strftime(endDate, '%Y-%m-%d') AS endDate, ecMaxContribution, acronym, legalBasis, objective,
  frameworkProgramme, totalCost, fundingScheme, predicted_label,
  CAST(predicted_prob AS DOUBLE) AS predicted_prob,
  titles AS list_euroSciVocTitle, paths AS list_euroSciVocPath,
  coalesce(publications, '') AS publications, concat_ws(',', {pairs}) AS explanations
FROM pg LEFT JOIN v ON v.projectID=pg.id LEFT JOIN k ON k.projectID=pg.id"""
    )


def _facets(where: str) -> str:
    return (
        _with(PROJECTS, ORGANIZATIONS, VOCABULARY)
        + f""", f AS (SELECT * FROM projects p WHERE {where}),
x AS (SELECT 'statuses' AS facet, status AS value FROM f
  UNION ALL SELECT 'legalBases', legalBasis FROM f
  UNION ALL SELECT 'fundingSchemes', fundingScheme FROM f
  UNION ALL SELECT 'organizations', name FROM f LEFT JOIN organizations ON projectID=id
  UNION ALL SELECT 'countries', country FROM f LEFT JOIN organizations ON projectID=id
  UNION ALL SELECT 'topics', euroSciVocTitle FROM f LEFT JOIN vocabulary ON projectID=id)
SELECT DISTINCT facet, coalesce(value, 'UNKNOWN') AS value FROM x"""
    )


_COORD = "try_cast(split_part(geolocation, ',', 1) AS DOUBLE) AS latitude, CASE WHEN contains(geolocation, ',') THEN try_cast(split_part(geolocation, ',', 2) AS DOUBLE) END AS longitude"
_ORG_ROW = f"projectID, name, city, CAST(SME AS VARCHAR) AS sme, role, ecContribution AS contribution, activityType, organizationURL AS orgURL, country, {_COORD}"


def browse_oracles() -> dict[str, str]:
    return {
        "stats_projects_per_year": _with(PROJECTS)
        + " SELECT year(startDate) AS label, count(*) AS value FROM projects "
        "WHERE startDate IS NOT NULL GROUP BY 1",
        "stats_project_size": _hist("totalCost"),
        "stats_funding_range": _hist("ecMaxContribution"),
        "stats_top_schemes": _with(PROJECTS)
        + ", agg AS (SELECT fundingScheme AS label, count(*) AS m FROM projects GROUP BY 1) "
        + _top("m"),
        "stats_top_topics": _with(PROJECTS, VOCABULARY, ORGANIZATIONS, _listed())
        + ", agg AS (SELECT label, coalesce(sum(ecMaxContribution),0) AS m FROM tv GROUP BY 1) "
        + _top("round(m/1e6,1)"),
        "stats_top_countries": _with(PROJECTS, VOCABULARY, ORGANIZATIONS, _listed())
        + ", agg AS (SELECT label, count(*) AS m FROM tc GROUP BY 1) "
        + _top("m"),
        "stats_all_series": _series("true"),
        "stats_from_wide": _series("true"),
        "stats_filtered": _series(
            "lower(status)='closed' AND lower(legalBasis)='building' AND "
            "regexp_matches(lower(fundingScheme), 'high|low') AND ecMaxContribution>=100000 "
            "AND ecMaxContribution<=9000000 AND year(startDate)>=1996 AND year(startDate)<=2000 "
            "AND year(endDate)>=1997 AND year(endDate)<=2001 AND " + _HAS_COUNTRY.format("NATION_3")
        ),
        "stats_status_unknown": _series("lower(status)='unknown'"),
        "browse_page": _page("true", "startDate DESC NULLS FIRST, id", 10, 20),
        "browse_page_asc_nulls": _page("true", "endDate ASC NULLS FIRST, id", 25),
        "browse_page_desc_nulls": _page("true", "totalCost DESC NULLS FIRST, id", 25, 400),
        "browse_page_by_duration": _page("true", f"{_DAYS} DESC NULLS FIRST, id", 20, 20),
        "browse_page_by_contribution": _page(
            "true",
            "(SELECT CASE WHEN count(*)>0 THEN coalesce(sum(netEcContribution), 0) END FROM organizations o "
            "WHERE o.projectID=p.id) ASC NULLS FIRST, id",
            20,
        ),
        "browse_deep_page": _page(f"({_DAYS}=40 AND id>900) OR {_DAYS}<40", f"{_DAYS} DESC, id", 15),
        "browse_search_regex": _page(
            "regexp_matches(lower(title), '^(auto|build).*nation_1[0-9]$')",
            "startDate DESC NULLS FIRST, id",
        ),
        "browse_status_unknown": _page("status IS NULL", "id DESC NULLS FIRST, id", 20),
        "browse_by_org": _page(
            _HAS_ORG.format("Supplier#000000007"), "ecMaxContribution DESC NULLS FIRST, id", 15
        ),
        "browse_by_topic": _page(
            _HAS_TOPIC.format("ECONOMY")
            + " AND "
            + _HAS_COUNTRY.format("NATION_3")
            + " AND regexp_matches(lower(fundingScheme), 'urg')",
            "title ASC NULLS FIRST, id",
            15,
        ),
        "browse_by_id": _page("id = 77", "startDate DESC NULLS FIRST, id"),
        "browse_keyset": _page(
            "startDate < DATE '1998-06-01' OR (startDate = DATE '1998-06-01' AND id > 100)",
            "startDate DESC NULLS FIRST, id",
        ),
        "facet_values": _facets("true"),
        "facet_filtered": _facets(
            "lower(status)='signed' AND regexp_matches(lower(title), 'nation_2') AND "
            + _HAS_COUNTRY.format("NATION_3")
        ),
        "catalog_distinct": _with(PROJECTS, ORGANIZATIONS)
        + """ SELECT 'status' AS catalog, lower(status) AS value FROM projects GROUP BY 1,2
UNION ALL SELECT 'legalBasis', lower(legalBasis) FROM projects GROUP BY 1,2
UNION ALL SELECT 'organization', name FROM projects LEFT JOIN organizations ON projectID=id GROUP BY 1,2
UNION ALL SELECT 'country', country FROM projects LEFT JOIN organizations ON projectID=id GROUP BY 1,2""",
        "project_organizations": _with(PROJECTS, ORGANIZATIONS)
        + f" SELECT {_ORG_ROW} FROM organizations WHERE name IS NOT NULL AND projectID=77 "
        "AND projectID IN (SELECT id FROM projects)",
        "organizations_of_terminated": _with(PROJECTS, ORGANIZATIONS)
        + f" SELECT {_ORG_ROW} FROM organizations WHERE name IS NOT NULL "
        "AND projectID IN (SELECT id FROM projects WHERE status='TERMINATED')",
        "organization_locations": _with(ORGANIZATIONS)
        + f" SELECT * FROM (SELECT {_ORG_ROW} FROM organizations WHERE name IS NOT NULL) "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    }
