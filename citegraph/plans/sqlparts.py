"""DuckDB SQL for the stand-in inputs (mirror of ``standins.py``).

Oracle queries are composed as ``WITH <parts> SELECT ...`` so that both
sides start from the same reference-shaped rows.
"""

OH = """oh AS (
  SELECT o.o_orderkey AS publication_id,
         CAST(year(o.o_orderdate) AS BIGINT) AS publication_year,
         s.s_suppkey AS author_id, s.s_name AS author_name,
         CAST(n.n_nationkey AS BIGINT) AS org_id, n.n_name AS organization_name,
         r.r_name AS country_name,
         CAST(r.r_regionkey AS BIGINT) AS high_level_org_id, r.r_name AS high_level_org_name,
         CAST(n.n_nationkey AS BIGINT) AS low_level_org_id, n.n_name AS low_level_org_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def edges_sql(level: str) -> str:
    """Co-occurrence edges CTE named ``e`` at one level (needs ``oh``)."""
    if level == "author":
        idc, name = "author_id", "{t}.author_name"
    elif level == "org":
        idc, name = "org_id", "{t}.organization_name"
    elif level == "country":
        idc, name = "country_name", "{t}.country_name"
    elif level == "high":
        idc, name = "high_level_org_id", "{t}.high_level_org_name"
    elif level == "low":
        idc, name = "low_level_org_id", "CONCAT({t}.low_level_org_name, ' (', {t}.high_level_org_name, ')')"
    else:
        raise ValueError(level)
    parent = " AND a.high_level_org_id = b.high_level_org_id" if level == "low" else ""
    return f"""e AS (
  SELECT a.publication_year AS year, {name.format(t='a')} AS node1, {name.format(t='b')} AS node2,
         COUNT(DISTINCT a.publication_id) AS weight
  FROM oh a JOIN oh b ON a.publication_id = b.publication_id
  WHERE a.{idc} < b.{idc}{parent}
  GROUP BY 1, 2, 3)"""


# node strength per (year, node) of ``e``
STRENGTH = """st AS (
  SELECT year, node, CAST(SUM(weight) AS BIGINT) AS strength FROM (
    SELECT year, node1 AS node, weight FROM e UNION ALL SELECT year, node2 AS node, weight FROM e) x
  GROUP BY year, node)"""

CII = """ci AS (
  SELECT e.*, COALESCE(
      CAST(e.weight AS DOUBLE) / NULLIF(CAST(s1.strength AS DOUBLE) * s2.strength / NULLIF(t.tot, 0), 0),
      0.0) AS cii
  FROM e
  LEFT JOIN st s1 ON s1.year = e.year AND s1.node = e.node1
  LEFT JOIN st s2 ON s2.year = e.year AND s2.node = e.node2
  JOIN (SELECT year, CAST(SUM(weight) AS DOUBLE) AS tot FROM e GROUP BY year) t ON t.year = e.year)"""

PROP = """pw AS (
  SELECT e.*, COALESCE(0.5 * (CAST(e.weight AS DOUBLE) / NULLIF(s1.strength, 0)
                            + CAST(e.weight AS DOUBLE) / NULLIF(s2.strength, 0)), 0.0) AS proportional_weight
  FROM e
  LEFT JOIN st s1 ON s1.year = e.year AND s1.node = e.node1
  LEFT JOIN st s2 ON s2.year = e.year AND s2.node = e.node2)"""

# canonical simple graph of ``g(year,node1,node2,w)``: repeated pairs -> summed here only
# when the caller's edge list cannot repeat; see graph_queries for the rule used.


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# lineitems with their supplier (author) and nation (organisation)
LINE = """line AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_discount, l.l_tax,
         l.l_returnflag, s.s_name, n.n_nationkey, n.n_regionkey, n.n_name
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

# flattened publication table (pubWhole) computed straight from the lines
PWH = """pwh AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS publication_id, CAST(year(o.o_orderdate) AS BIGINT) AS year,
         strftime(o.o_orderdate, '%Y-%m-%d') AS date, o.o_orderpriority AS publication_type,
         COALESCE(g.cti, '') AS clinical_trial_ids, o.o_totalprice AS citation_count,
         g.times_cited, g.recent_citations, g.field_citation_ratio, g.relative_citation_ratio,
         o.o_totalprice / 1000.0 AS altmetric_score, g.l_orderkey IS NOT NULL AS is_open_access,
         COALESCE(g.n_lines, 0) AS n_authors, COALESCE(g.n_lines, 0) AS n_funding,
         COALESCE(g.orgs, '') AS unique_org_ids, '' AS research_org_city_ids,
         COALESCE(g.ccs, '') AS research_org_country_codes, '' AS research_org_state_codes,
         COALESCE(g.norg, 0) AS num_unique_orgs
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ', ') AS cti,
           CAST(SUM(l_quantity) AS BIGINT) AS times_cited, COUNT(*) AS recent_citations,
           AVG(l_discount) AS field_citation_ratio, AVG(l_tax) AS relative_citation_ratio, COUNT(*) AS n_lines,
           array_to_string(list_sort(list_distinct(list(CAST(n_nationkey AS VARCHAR)))), ', ') AS orgs,
           array_to_string(list_sort(list_distinct(list(CAST(n_regionkey AS VARCHAR)))), ', ') AS ccs,
           CAST(COUNT(DISTINCT n_nationkey) AS BIGINT) AS norg
    FROM line GROUP BY l_orderkey) g ON g.l_orderkey = o.o_orderkey)"""

# one row per (publication, author line): name, position in the sorted author list
AROWS = """arows AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS publication_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_suppkey AS VARCHAR)) - 1 AS INTEGER) AS pos,
         CAST(l_suppkey AS VARCHAR) AS researcher_id,
         split_part(s_name, '#', 1) || ' ' || split_part(s_name, '#', 2) AS concatenated_name,
         n_name, n_nationkey, n_regionkey
  FROM line)"""
