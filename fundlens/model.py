"""Entities, their fixed schemas, and the container that queries work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Store:
    """Projects and child tables in long form: one row per child, keyed by ``projectID``.

    ``ord`` orders the children of a project; ``seg`` is a coarse number that grows with ``ord`` and
    is used only to split projects with very many children. A table may be given as a function; it
    is then built on first use.
    """

    NAMES = (
        "projects",
        "organizations",
        "vocabulary",
        "publications",
        "topics",
        "deliverables",
        "reports",
        "web_links",
        "legal_bases",
    )

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(self.NAMES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        if not isinstance(tables[name], DataFrame):
            tables[name] = tables[name]()
        return tables[name]

    def replace(self, **changes: DataFrame | Callable[[], DataFrame]) -> Store:
        return Store(**{**self._tables, **changes})


# Dataset names of the programme folders.
DATASETS = [
    "project",
    "projectDeliverables",
    "projectPublications",
    "reportSummaries",
    "organization",
    "euroSciVoc",
    "topics",
    "webItem",
    "webLink",
    "legalBasis",
]

# List columns of the consolidated table, per child table. The names follow from
# joining the children in this order and adding a suffix to a name that is already taken.
LIST_COLUMNS = {
    "deliverables": {
        "deliverableType": "list_deliverableType",
        "url": "list_url",
        "contentUpdateDate": "list_contentUpdateDate",
    },
    "publications": {
        "authors": "list_authors",
        "title": "list_title",
        "doi": "list_doi",
        "journalTitle": "list_journalTitle",
        "isPublishedAs": "list_isPublishedAs",
        "publishedYear": "list_publishedYear",
        "contentUpdateDate": "list_contentUpdateDate_publi",
    },
    "reports": {
        "title": "list_title_report",
        "attachment": "list_attachment",
        "contentUpdateDate": "list_contentUpdateDate_report",
    },
    "organizations": {
        "organisationID": "list_organisationID",
        "country": "list_country",
        "name": "list_name",
        "SME": "list_SME",
        "city": "list_city",
        "geolocation": "list_geolocation",
        "organizationURL": "list_organizationURL",
        "role": "list_role",
        "ecContribution": "list_ecContribution",
        "netEcContribution": "list_netEcContribution",
        "totalCost": "list_totalCost",
        "endOfParticipation": "list_endOfParticipation",
        "activityType": "list_activityType",
        "contentUpdateDate": "list_contentUpdateDate_org",
    },
    "web_links": {
        "physUrl": "list_physUrl",
        "availableLanguages": "list_availableLanguages",
        "status": "list_status",
        "archivedDate": "list_archivedDate",
        "type": "list_type",
        "source": "list_source",
        "represents": "list_represents",
    },
    "legal_bases": {
        "legalBasis": "list_legalBasis",
        "title": "list_title_legal",
        "uniqueProgrammePart": "list_uniqueProgrammePart",
    },
    "topics": {"topic": "list_topic", "title": "list_title_topic"},
    "vocabulary": {
        "euroSciVocTitle": "list_euroSciVocTitle",
        "euroSciVocPath": "list_euroSciVocPath",
        "euroSciVocDescription": "list_description",
    },
}

# Framework programmes left out of the clean table.
EXCLUDED_FRAMEWORKS = ["FP1", "FP2", "FP3", "FP4", "FP5", "FP6"]
