"""The data model views in plain SQL, shared by the oracle queries."""

PROJECTS = """
li AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) endd,
         CAST(sum(CAST(l_extendedprice*(1-l_discount) AS DECIMAL(18,4))) AS DOUBLE)*10 ec FROM lineitem GROUP BY 1),
projects AS (
  SELECT o_orderkey AS id, 'A' || o_orderkey AS acronym,
    CASE WHEN o_orderkey%50=0 THEN NULL WHEN o_orderstatus='F' THEN 'CLOSED'
         WHEN o_orderstatus='P' THEN 'TERMINATED' ELSE 'SIGNED' END AS status,
    concat_ws(' ', c_mktsegment, substr(o_orderpriority, 3), n_name) AS title,
    CAST(o_orderdate AS DATE) AS startDate,
    CASE WHEN o_orderkey%37<>0 THEN o_totalprice*50 END AS totalCost,
    c_mktsegment AS legalBasis, 'FP' || (o_custkey%9+1) AS frameworkProgramme,
    o_orderpriority AS fundingScheme,
    CASE WHEN o_orderkey%41<>0 THEN 'N' || n_regionkey END AS nature,
    concat_ws(' ', c_name, n_name, o_orderpriority) AS objective,
    endd AS endDate, ec AS ecMaxContribution
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  LEFT JOIN li ON l_orderkey=o_orderkey)
"""

_ORD = "l_orderkey AS projectID, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

ORGANIZATIONS = f"""
organizations AS (
  SELECT {_ORD}, CAST(s_suppkey AS VARCHAR) AS organisationID,
    CASE WHEN s_suppkey%50<>0 THEN s_name END AS name, n_name AS country, 'C' || s_nationkey AS city,
    CASE WHEN s_suppkey%9<>0 THEN s_acctbal<0 END AS SME,
    CASE WHEN s_nationkey%7=0 THEN NULL WHEN s_nationkey%5=0 THEN 'unknown'
         ELSE s_nationkey || '.5,-' || (s_nationkey*2) END AS geolocation,
    'http://org' || s_suppkey AS organizationURL, l_linestatus AS role,
    l_extendedprice AS ecContribution,
    CASE WHEN l_suppkey%6<>0 THEN l_quantity END AS netEcContribution, l_returnflag AS activityType
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey)
"""

VOCABULARY = f"""
vocabulary AS (
  SELECT {_ORD}, p_type AS euroSciVocTitle,
    '/' || p_type || '/' || p_brand || '/' || p_name AS euroSciVocPath
  FROM lineitem JOIN part ON l_partkey=p_partkey)
"""

PUBLICATIONS = f"""
publications AS (
  SELECT {_ORD}, p_name AS title, CASE WHEN l_partkey%11<>0 THEN p_type END AS isPublishedAs,
    year(l_shipdate) AS publishedYear
  FROM lineitem JOIN part ON l_partkey=p_partkey)
"""

SCORED = "scored AS (SELECT *, CAST(id*37%1000/1000.0 >= 0.5 AS INT) AS predicted_label, id*37%1000/1000.0 AS predicted_prob" + "".join(
    f", CASE WHEN id%{10 + i}<>0 THEN 'num__n_f' || ((id+{i})%8) END AS top{i}_feature,"
    f" (id*{i + 3}%200-100)/100.0 AS top{i}_shap"
    for i in range(1, 7)
) + " FROM projects)"
