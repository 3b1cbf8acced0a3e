"""Nested publication records: projection, flattening, re-nesting.

The reference flattens with four chained ``LEFT JOIN UNNEST`` and groups
back, which multiplies independent arrays into a cross product. Here every
per-publication list is computed with higher-order functions on the row
itself (``transform``/``flatten``/``array_distinct``), so the flattening of
``pubWhole`` needs no shuffle at all and no cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.functions.columns import col, full_name, nonempty_flag


def struct_project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select nested fields under new names (#14): {out: 'a.b'}."""
    return df.select(*[F.col(path).alias(out) for out, path in mapping.items()])


def cast_project(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast listed columns, keep the others (#15)."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def sorted_distinct_join(arr: Column, sep: str = ", ") -> Column:
    """ARRAY_TO_STRING(ARRAY_AGG(DISTINCT x)) on a row's array; sorted, NULLs dropped (#34, #35)."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(arr, lambda x: x.isNotNull()))), sep)


def pub_whole(pubs: DataFrame) -> DataFrame:
    """Flattened publication table (#31, #33, #34, #35, #15, #17, #62, #63).

    One output row per publication, computed row-locally: author and funding
    structs are projected once per element, organisation lists are the
    distinct, sorted values over all authors' affiliations.
    """
    orgs = F.flatten(F.transform(F.coalesce("authors", F.array()), lambda a: F.coalesce(a["affiliations_address"], F.array())))
    return pubs.select(
        F.col("id").alias("publication_id"),
        F.col("year"),
        F.col("date"),
        F.col("type").alias("publication_type"),
        sorted_distinct_join(F.col("clinical_trial_ids")).alias("clinical_trial_ids"),
        F.col("citations_count").cast("double").alias("citation_count"),
        F.col("metrics.times_cited").cast("bigint").alias("times_cited"),
        F.col("metrics.recent_citations").cast("bigint").alias("recent_citations"),
        F.col("metrics.field_citation_ratio").cast("double").alias("field_citation_ratio"),
        F.col("metrics.relative_citation_ratio").cast("double").alias("relative_citation_ratio"),
        F.col("altmetrics.score").cast("double").alias("altmetric_score"),
        nonempty_flag("funding_details").alias("is_open_access"),
        F.transform(
            "authors",
            lambda a: F.struct(
                a["researcher_id"].alias("researcher_id"),
                a["first_name"].alias("first_name"),
                a["last_name"].alias("last_name"),
                a["grid_ids"].alias("author_grid_ids"),
                a["orcid"].alias("orcid"),
            ),
        ).alias("authors"),
        F.transform(
            "funding_details",
            lambda f: F.struct(f["grant_id"].alias("grant_id"), f["grid_id"].alias("funder_grid_id")),
        ).alias("funding_details"),
        sorted_distinct_join(F.transform(orgs, lambda o: o["grid_id"])).alias("unique_org_ids"),
        sorted_distinct_join(F.transform(orgs, lambda o: o["city_id"])).alias("research_org_city_ids"),
        sorted_distinct_join(F.transform(orgs, lambda o: o["country_code"])).alias("research_org_country_codes"),
        sorted_distinct_join(F.transform(orgs, lambda o: o["state_code"])).alias("research_org_state_codes"),
        F.size(F.array_distinct(F.filter(F.transform(orgs, lambda o: o["grid_id"]), lambda x: x.isNotNull())))
        .cast("bigint")
        .alias("num_unique_orgs"),
    )


def unnest_inner(df: DataFrame, key: str, arr: str, fields: dict[str, str], not_null: str | None = None) -> DataFrame:
    """``FROM t, UNNEST(arr)`` (#32): one row per element, optional not-null filter."""
    x = df.select(F.col(key), F.explode(arr).alias("_e")).select(
        F.col(key), *[F.col(f"_e.{src}").alias(out) for out, src in fields.items()]
    )
    return x.filter(F.col(not_null).isNotNull()) if not_null else x


def collect_structs(df: DataFrame, key: str, fields: list[str], out: str) -> DataFrame:
    """ARRAY_AGG(STRUCT(...)) per key (#33), sorted for determinism."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def distinct_list_string(df: DataFrame, key: str, c: str, out: str, sep: str = ", ") -> DataFrame:
    """ARRAY_TO_STRING(ARRAY_AGG(DISTINCT x), sep) per key (#34)."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(c)), sep).alias(out))


def array_to_string(df: DataFrame, c: str, out: str, sep: str = ", ") -> DataFrame:
    """Join an array column with ``sep`` (#35)."""
    return df.withColumn(out, F.array_join(col(c), sep))


def first_matching(arr, pred, field: str, default=None) -> Column:
    """Field of the first element matching ``pred`` in array order, else ``default`` (#36).

    ``get`` returns NULL past the end where ``[0]`` raises under ANSI.
    """
    hit = F.get(F.filter(col(arr), pred), 0)[field]
    return F.coalesce(hit, col(default)) if default is not None else hit


def org_hierarchy_from_nested(pubs: DataFrame, grid: DataFrame) -> DataFrame:
    """Affiliation fact from nested publications and the organisation dimension (#31, #36, #57).

    publications -> authors -> affiliations (outer), joined to the grid
    row of each affiliation; the parent is the first 'Parent' relationship
    in array order, falling back to the organisation itself.
    """
    a = pubs.select(
        F.col("id").alias("publication_id"),
        F.col("year").cast("bigint").alias("publication_year"),
        F.explode_outer("authors").alias("author"),
    )
    o = a.select(
        "publication_id",
        "publication_year",
        F.col("author.researcher_id").alias("author_id"),
        full_name(F.col("author")).alias("author_name"),
        F.explode_outer("author.affiliations_address").alias("org"),
    )
    g = grid.select(
        F.col("id").alias("_gid"),
        F.col("name").alias("organization_name"),
        F.col("address.country").alias("country_name"),
        F.col("address.latitude").alias("latitude"),
        F.col("address.longitude").alias("longitude"),
        first_matching("relationships", lambda r: r["type"] == "Parent", "id").alias("_pid"),
        first_matching("relationships", lambda r: r["type"] == "Parent", "label").alias("_plabel"),
        first_matching("relationships", lambda r: r["type"] == "Child", "id").alias("low_level_org_id"),
        F.concat(
            first_matching("relationships", lambda r: r["type"] == "Child", "label"), F.lit(" ("), F.col("name"), F.lit(")")
        ).alias("low_level_org_name"),
    )
    return (
        o.join(g, o["org.grid_id"] == g["_gid"], "left")
        .select(
            "publication_id",
            "publication_year",
            "author_id",
            "author_name",
            F.col("org.grid_id").alias("org_grid_id"),
            "country_name",
            "latitude",
            "longitude",
            "organization_name",
            F.coalesce("_pid", F.col("org.grid_id")).alias("high_level_org_id"),
            F.coalesce("_plabel", F.col("organization_name")).alias("high_level_org_name"),
            "low_level_org_id",
            "low_level_org_name",
        )
        .dropDuplicates()
    )


def author_rows(pubs: DataFrame, key: str = "publication_id", arr: str = "authors", keep: list[str] | None = None) -> DataFrame:
    """One row per (publication, author) with ``concatenated_name`` (#39); NULL names dropped."""
    keep = keep or []
    return (
        pubs.select(key, *keep, F.posexplode_outer(arr).alias("pos", "author"))
        .withColumn("concatenated_name", full_name(F.col("author")))
        .filter(F.col("concatenated_name").isNotNull())
    )


def array_dedup_by_key(pubs: DataFrame, key: str = "publication_id", arr: str = "authors", keep: list[str] | None = None) -> DataFrame:
    """Keep the first author struct per full name within a publication (#37).

    Row form: exploded with positions, the first position per
    (publication, name) kept via ``min_by``; this distributes a long author
    list over the (publication, name) shuffle instead of an O(n^2) scan in
    one row.
    """
    keep = keep or []
    rows = author_rows(pubs, key, arr, keep)
    return rows.groupBy(key, "concatenated_name").agg(
        F.min("pos").alias("pos"),
        F.min_by("author", "pos").alias("author"),
        *[F.first(k).alias(k) for k in keep],
    )


def array_map_names(df: DataFrame, arr: str = "authors", out: str = "author_names", sep: str = ", ") -> DataFrame:
    """List of full names from author structs (#38), joined as text."""
    return df.withColumn(out, F.array_join(F.transform(col(arr), lambda a: full_name(a)), sep))


def author_group_key(df: DataFrame, arr: str = "authors", out: str = "author_group") -> DataFrame:
    """Group key of a publication's author list (#28).

    Per author: first grid id when there is one, else ``first_last``;
    joined with '_' over the list (an empty list gives ''); NULL list -> 'Unknown'.
    """
    per = F.transform(
        col(arr),
        lambda a: F.when(F.size(a["author_grid_ids"]) > 0, F.get(a["author_grid_ids"], 0)).otherwise(
            F.concat_ws("_", a["first_name"], a["last_name"])
        ),
    )
    return df.withColumn(
        out, F.when(col(arr).isNotNull(), F.array_join(per, "_")).otherwise(F.lit("Unknown"))
    )


def valid_points(df: DataFrame, c: str) -> DataFrame:
    """Parse a text list '[x, y]'; keep two non-null numbers as x, y (#29)."""
    arr = F.from_json(col(c), "array<double>")
    ok = (F.size(arr) == 2) & F.forall(arr, lambda v: v.isNotNull())
    return df.withColumn("_pt", arr).filter(ok).withColumn("x", F.col("_pt")[0]).withColumn("y", F.col("_pt")[1]).drop("_pt")
