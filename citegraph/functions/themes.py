"""Theme dimension of the dashboard.

Fixed values of the reference (copied as data, in their natural order):
cluster number, the cluster's exemplar id, and its display name.
"""

THEMES = [
    (1, 20, "Social Impacts and Public Health"),
    (2, 174, "Medical and Patient-Focused Research"),
    (3, 263, "Nutritional and Prevention Research"),
    (4, 312, "Policy and Governance"),
    (5, 328, "Clinical Trials and Patient Outcomes"),
    (6, 409, "Educational Changes"),
    (7, 413, "Digital and Remote Learning"),
    (8, 429, "Social Media and Information Dissemination"),
    (9, 505, "Disease Spread and Impact"),
    (10, 585, "Health Risks and Vulnerabilities"),
    (11, 643, "Pandemic Response and Learning Systems"),
    (12, 668, "COVID and Sociocultural Dynamics"),
    (13, 687, "Environmental Impact and Behavior"),
    (14, 759, "Psychological and Social Support"),
    (15, 763, "Public Health and Healthcare Systems"),
    (16, 886, "Artificial Intelligence and Data Analysis"),
    (17, 896, "Social Distancing and Community Response"),
    (18, 930, "Digital Health and Telemedicine"),
    (19, 967, "Clinical Evidence and Treatment"),
    (20, 971, "Global and Policy Impact"),
]


def theme_dimension(spark):
    """(cluster_number, cluster_id, cluster_name) as a DataFrame (20 rows)."""
    return spark.createDataFrame(THEMES, "cluster_number INT, cluster_id INT, cluster_name STRING")


def theme_values_sql() -> str:
    rows = ", ".join(f"({n}, {i}, '{name}')" for n, i, name in THEMES)
    return f"(VALUES {rows}) AS th(cluster_number, cluster_id, cluster_name)"
