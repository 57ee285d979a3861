"""Queries: profiling, dictionary matching, column roles, catalog decisions and cohort reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitline.functions import names as N
from visitline.operators import catalog as C, selection as W
from visitline.operators.selection import any_available
from visitline.plans.registry import query, rounded
from visitline.plans.standins import FEATURES, VISITS_SQL, bare_visits, table, visits

# --- profiling ---------------------------------------------------------------------------------


def _profile_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, "
        f"CAST(count({c}) AS BIGINT) AS non_missing_count, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM {source}"
        for c in columns
    )


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]


@query("column_profile", _profile_sql("lineitem", _LINE))
def column_profile(spark, sf):
    return rounded(C.column_profile(table(spark, sf, "lineitem")))


_VISIT_COLS = ["subject", "visit_date", "state", "row_id", "spend", "priority", "balance", "segment", "visit_code"]


@query("column_profile_with_missing", f"WITH {VISITS_SQL} " + _profile_sql("visits", _VISIT_COLS))
def column_profile_with_missing(spark, sf):
    return rounded(C.column_profile(visits(spark, sf)))


@query(
    "top_missing_rates",
    f"WITH {VISITS_SQL}, m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS missing_rate FROM visits" for c in _VISIT_COLS
    ) + ") SELECT column_name, round(missing_rate, 4) AS missing_rate FROM m ORDER BY missing_rate DESC, column_name LIMIT 10",
)
def top_missing_rates(spark, sf):
    rates = C.missing_rates(visits(spark, sf))
    return rounded(rates.orderBy(F.desc("missing_rate"), "column_name").limit(10), 4)


@query(
    "table_audit",
    f"""WITH {VISITS_SQL} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT subject) AS BIGINT) AS n_subjects,
      CAST(count(*) - count(DISTINCT (subject, visit_date)) AS BIGINT) AS duplicate_subject_visit_rows, CAST(9 AS INTEGER) AS n_columns,
      CAST(4 AS INTEGER) AS numeric_columns, CAST(5 AS INTEGER) AS categorical_columns FROM visits""",
)
def table_audit(spark, sf):
    return C.table_audit(visits(spark, sf), "subject", "visit_date", "priority")["summary"]


@query(
    "label_distribution",
    f"WITH {VISITS_SQL} SELECT coalesce(priority, '<missing>') AS label, CAST(count(*) AS BIGINT) AS rows FROM visits GROUP BY 1",
)
def label_distribution(spark, sf):
    return C.table_audit(visits(spark, sf), "subject", "visit_date", "priority")["labels"]


@query(
    "missing_rate_audit",
    f"WITH {VISITS_SQL}, m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS missing_rate FROM visits" for c in _VISIT_COLS
    ) + ") SELECT column_name, round(missing_rate, 6) AS missing_rate, missing_rate > 0.15 AS over_threshold FROM m",
)
def missing_rate_audit(spark, sf):
    return rounded(C.table_audit(visits(spark, sf), "subject", "visit_date", "priority", 0.15)["missing"])


@query(
    "duplicate_subject_visits",
    f"WITH {VISITS_SQL}, k AS (SELECT count(*) AS n FROM visits GROUP BY subject, visit_date) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM k",
)
def duplicate_subject_visits(spark, sf):
    return C.duplicate_rows(bare_visits(spark, sf), ["subject", "visit_date"])


# --- dictionary --------------------------------------------------------------------------------

_DICT_SQL = """dict AS (SELECT CASE WHEN p_size = 50 THEN 'FLDNAME' ELSE ' ' || p_name END AS "FLDNAME", p_brand AS "TBLNAME",
   CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS "TEXT", CASE WHEN p_size < 20 THEN '' ELSE 'N' END AS "TYPE",
   CASE WHEN p_size < 40 THEN '' ELSE 'mm' END AS "UNITS", p_partkey AS position FROM part)"""


def _dictionary(spark, sf):
    blank = lambda test, v: F.when(test, "").otherwise(v)
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.when(size == 50, "FLDNAME").otherwise(F.concat(F.lit(" "), "p_name")).alias("FLDNAME"),
        F.col("p_brand").alias("TBLNAME"),
        blank(F.col("p_type") == "SMALL", F.col("p_type")).alias("TEXT"),
        blank(size < 20, F.lit("N")).alias("TYPE"),
        blank(size < 40, F.lit("mm")).alias("UNITS"),
        F.col("p_partkey").alias("position"),
    )


@query(
    "dictionary_match",
    f"""WITH {_DICT_SQL}, cols AS (SELECT DISTINCT upper(p_name) AS column_name FROM part UNION ALL SELECT DISTINCT p_brand FROM part),
    ranked AS (SELECT lower(trim("FLDNAME")) AS key, *, row_number() OVER (PARTITION BY lower(trim("FLDNAME")) ORDER BY
       ("TBLNAME" <> '')::INT + ("TEXT" <> '')::INT + ("TYPE" <> '')::INT + ("UNITS" <> '')::INT DESC, position) AS rn
       FROM dict WHERE trim("FLDNAME") <> '' AND upper(trim("FLDNAME")) <> 'FLDNAME')
    SELECT column_name, "FLDNAME", "TBLNAME", "TEXT", "TYPE", "UNITS", "FLDNAME" IS NOT NULL AS dictionary_match
    FROM cols LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) ON lower(column_name) = key""",
)
def dictionary_match(spark, sf):
    part = table(spark, sf, "part")
    columns = part.select(F.upper("p_name").alias("column_name")).distinct().unionByName(
        part.select(F.col("p_brand").alias("column_name")).distinct()
    )
    return C.match_dictionary(columns, _dictionary(spark, sf), "position")


# --- column roles ------------------------------------------------------------------------------

# Column names that meet every role rule, dealt to the parts by size.
_NAMES = [
    "RID", "PTID_x", "DX", "DX_bl", "DXCHANGE", "VISCODE2", "EXAMDATE_UCSFFSL", "Month_bl", "SITE", "MRI_QC_flag", "COMMENT2",
    "ABETA", "TAU_UPENNBIOMK9_04_19_17", "FA_CST", "FDG_bl", "AV45", "PIB_bl", "AV1451_x", "SUVR_mean", "ST101SV_UCSFFSX_11_02_15",
    "Hippocampus_bl", "AGE", "PTGENDER", "MMSE_bl", "RAVLT_learning", "CDRSB", "APOE4", "APGEN1", "aspirin", "asthma",
    "plasma_nfl", "Ventricles", "WholeBrain_bl", "ICV", "weight", "LDELTOTAL", "MOCA_bl", "PTAU_x", "STATUS", "D1",
    "IMAGEUID_UCSFFSX", "YEARS_BL", "Fusiform", "EcogPt", "mPACC", "PTRACCAT", "CLOCKSCOR", "genotype_x", "MD_value", "FAQ",
]
_SOURCES = {"ECONOMY": "ADNIMERGE", "STANDARD": "UCSFFSX", "SMALL": "", "MEDIUM": "DTIROI", "LARGE": "BAIPETNMRC", "PROMO": "UCBERKELEYAV45"}
_NAMES_SQL = "list_value(" + ", ".join(f"'{n}'" for n in _NAMES) + ")[p_size]"
_TEXTS = {"Brand#1": "Diffusion tensor", "Brand#2": "medication list", "Brand#3": "family history", "Brand#4": "serum level", "Brand#5": "cortical thickness"}
_SRC_SQL = "coalesce(CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SOURCES.items()) + " END, '')"
_TXT_SQL = "coalesce(CASE p_brand " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TEXTS.items()) + " END, '')"
_CASCADE_SQL = """CASE
   WHEN base IN ('DX','DXCHANGE','DIAGNOSIS') THEN 'label'
   WHEN base = 'DX_BL' THEN 'baseline_diagnosis'
   WHEN base IN ('RID','PTID','LONIUID','LONISID','IMAGEUID') OR regexp_matches(n, '^(RID|PTID|LONIUID|LONISID|IMAGEUID)_') THEN 'identifier'
   WHEN n IN ('VISCODE','VISCODE2','EXAMDATE','SCANDATE','VISDATE','MONTH_BL','YEARS_BL') OR base IN ('VISCODE','VISCODE2','EXAMDATE','SCANDATE','VISDATE','MONTH_BL','YEARS_BL')
     OR regexp_matches(n, '^(VISCODE|VISCODE2|EXAMDATE|SCANDATE|VISDATE|MONTH_BL|YEARS_BL)_') THEN 'visit_time'
   WHEN base IN ('D1','D2','SITE','COLPROT','ORIGPROT','PHASE','RUNDATE','STATUS','VERSION','UPDATE_STAMP') OR regexp_matches(n, 'RUNDATE|STATUS|VERSION|UPDATE_STAMP|QC|COMMENT') THEN 'administrative'
   WHEN src = 'UPENNBIOMK9' OR regexp_matches(n, '^(ABETA|ABETA42|TAU|PTAU|PTAU181)($|_)|UPENNBIOMK|ELECSYS') OR contains(txt, 'ELECSYS') THEN 'csf'
   WHEN src = 'DTIROI' OR regexp_matches(txt, 'DIFFUSION|DIFFUSIVITY') THEN 'mri_dti'
   WHEN src = 'BAIPETNMRC' OR n LIKE 'FDG%' THEN 'pet_fdg'
   WHEN src = 'UCBERKELEYAV45' OR regexp_matches(n, 'AV45|PIB|FLORBETAPIR|CENTILOID') THEN 'pet_amyloid'
   WHEN src = 'UCBERKELEYAV1451' OR regexp_matches(n, '^(FDG|PIB|AV45)($|_)|AV1451|FLORBETAPIR|FLORTAUCIPIR|SUVR|CENTILOID') THEN 'pet_other'
   WHEN src IN ('UCSFFSL','UCSFFSX') OR regexp_matches(txt, 'FREESURFER|CORTICAL THICKNESS|BRAIN VOLUME|HIPPOCAMP') THEN 'mri_structural'
   WHEN regexp_matches(base, '^(AGE|PTGENDER|PTEDUCAT|PTETHCAT|PTRACCAT|PTMARRY|PTDOB)') THEN 'demographic'
   WHEN regexp_matches(base, '^(ADAS|MMSE|RAVLT|CDR|FAQ|LDELT|TRAB|CLOCK|LOGMEM|CATFLU|WAISR|MOCA)') THEN 'cognitive'
   WHEN regexp_matches(base, 'APOE|APGEN|GENOTYPE') THEN 'genetic'
   WHEN regexp_matches(txt, 'MEDICATION|DRUG|PRESCRIPTION') THEN 'medication'
   WHEN contains(txt, 'HISTORY') THEN 'medical_history'
   WHEN regexp_matches(txt, 'PLASMA|SERUM|BIOFLUID|BIOMARKER') THEN 'biofluid_other'
   WHEN src = 'ADNIMERGE' AND regexp_matches(base, 'VENTRICLES|HIPPOCAMPUS|WHOLEBRAIN|ENTORHINAL|FUSIFORM|MIDTEMP|ICV') THEN 'mri_structural'
   ELSE 'unknown' END"""
_ROLE_SQL = f"""named AS (SELECT p_partkey, {_NAMES_SQL} AS column_name, {_SRC_SQL} AS source, {_TXT_SQL} AS description FROM part),
 prep AS (SELECT *, upper(column_name) AS n, upper(source) AS src, upper(column_name || ' ' || source || ' ' || description) AS txt,
   CASE WHEN upper(column_name) <> 'DX_BL' THEN regexp_replace(upper(column_name), '_BL$', '') ELSE upper(column_name) END AS base FROM named),
 roles AS (SELECT p_partkey, column_name, source, description, {_CASCADE_SQL} AS role FROM prep)"""


def _named_parts(spark, sf):
    from visitline.functions.states import literal_map

    lookup = lambda pairs, c: F.coalesce(F.try_element_at(literal_map(pairs), F.col(c)), F.lit(""))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("p_size") - 1).alias("column_name"),
        lookup(_SOURCES, "p_type").alias("source"),
        lookup(_TEXTS, "p_brand").alias("description"),
    )


@query("column_roles", f"WITH {_ROLE_SQL} SELECT p_partkey, column_name, source, description, role FROM roles")
def column_roles(spark, sf):
    rows = _named_parts(spark, sf)
    return rows.withColumn("role", N.column_role(F.col("column_name"), F.col("source"), F.col("description")))


@query(
    "measurement_families",
    f"""WITH {_ROLE_SQL} SELECT column_name, regexp_replace(regexp_replace(upper(column_name),
      '_(UCSFFSL|UCSFFSX|BAIPETNMRC|UCBERKELEYAV45|UCBERKELEYAV1451|DTIROI|UPENNBIOMK).*$', ''), '_BL$', '') AS family, CAST(count(*) AS BIGINT) AS n FROM named GROUP BY 1, 2""",
)
def measurement_families(spark, sf):
    rows = _named_parts(spark, sf).withColumn("family", N.measurement_family(F.col("column_name")))
    return rows.groupBy("column_name", "family").agg(F.count("*").alias("n"))


_GROUPS = [("amyloid", "AV45"), ("cognitive", "MMSE"), ("cognitive", "RAVLT"), ("imaging", "ST101SV"), ("demographic", "PTGENDER")]


@query(
    "encoded_feature_groups",
    f"""WITH {_ROLE_SQL}, e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'num__' || column_name ELSE column_name || '=a' END AS feature FROM named),
    c AS (SELECT feature, CASE WHEN contains(feature, '__') THEN split_part(feature, '__', 2) ELSE feature END AS clean FROM e)
    SELECT feature, CASE """ + " ".join(
        f"WHEN clean = '{col}' OR starts_with(clean, '{col}_') OR starts_with(clean, '{col}=') THEN '{g}'" for g, col in _GROUPS
    ) + """ ELSE 'other' END AS feature_group, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1, 2""",
)
def encoded_feature_groups(spark, sf):
    rows = _named_parts(spark, sf)
    encoded = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("num__"), "column_name")).otherwise(
        F.concat("column_name", F.lit("=a"))
    )
    tagged = rows.select(encoded.alias("feature")).withColumn("feature_group", N.encoded_feature_group(F.col("feature"), _GROUPS))
    return tagged.groupBy("feature", "feature_group").agg(F.count("*").alias("n"))


# --- catalog decisions: the parts are candidate columns, size and price give availability -------

_CAND_SQL = f"""{_ROLE_SQL}, st0 AS (SELECT r.p_partkey, r.column_name || '_' || r.p_partkey AS column_name, r.role,
   'fam' || (p_partkey % 50) AS measurement_family, round(p_size / CAST(60 AS DOUBLE), 6) AS missing_rate,
   CAST(p_partkey AS BIGINT) AS non_missing_count, r.source <> '' AS dictionary_match, r.description = '' AS available_in_scoring FROM roles r JOIN part USING (p_partkey)),
 st1 AS (SELECT *, CASE WHEN role IN ('label','baseline_diagnosis','visit_time') THEN 'exclude_leakage' WHEN role = 'identifier' THEN 'exclude_identifier'
   WHEN role = 'administrative' THEN 'exclude_administrative' WHEN role NOT IN ('demographic','cognitive','mri_structural','mri_dti','pet_fdg','pet_amyloid','pet_other','csf','genetic','biofluid_other') THEN 'exclude_unresolved'
   WHEN missing_rate > 0.7 OR non_missing_count < 100 THEN 'exclude_high_missing' ELSE 'include_optional' END AS use1 FROM st0),
 st2 AS (SELECT *, CASE WHEN use1 = 'include_optional' AND row_number() OVER (PARTITION BY measurement_family, use1 = 'include_optional'
   ORDER BY available_in_scoring DESC, missing_rate, dictionary_match DESC, column_name) > 2 THEN 'exclude_duplicate' ELSE use1 END AS use2 FROM st1),
 q AS (SELECT * FROM (VALUES ('demographic', 0, 12), ('cognitive', 1, 40), ('mri_structural', 2, 50), ('mri_dti', 3, 35), ('pet_fdg', 4, 15), ('pet_amyloid', 5, 15),
   ('pet_other', 6, 15), ('csf', 7, 10), ('genetic', 8, 5), ('biofluid_other', 9, 3)) t(role, ord, quota)),
 c AS (SELECT st2.column_name, ord, quota, row_number() OVER (PARTITION BY st2.role ORDER BY available_in_scoring DESC, missing_rate, dictionary_match DESC, column_name) AS pl
   FROM st2 JOIN q USING (role) WHERE use2 = 'include_optional'),
 sel AS (SELECT column_name, row_number() OVER (ORDER BY ord, pl) AS tot FROM c WHERE pl <= quota),
 cat AS (SELECT st2.*, CASE WHEN tot <= 60 THEN 'include_primary' ELSE use2 END AS recommended_use FROM st2 LEFT JOIN sel USING (column_name))"""


def _candidates(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    roles = column_roles(spark, sf)
    return roles.join(part, "p_partkey").select(
        "p_partkey",
        F.concat_ws("_", "column_name", F.col("p_partkey").cast("string")).alias("column_name"),
        "role",
        F.concat(F.lit("fam"), (F.col("p_partkey") % 50).cast("string")).alias("measurement_family"),
        F.round(F.col("p_size") / F.lit(60.0), 6).alias("missing_rate"),
        F.col("p_partkey").alias("non_missing_count"),
        (F.col("source") != "").alias("dictionary_match"),
        (F.col("description") == "").alias("available_in_scoring"),
    ).withColumn(
        "recommended_use",
        C.initial_status(F.col("role"), F.col("missing_rate"), F.col("non_missing_count"), 0.7, 100),
    )


@query("initial_recommendation", f"WITH {_CAND_SQL} SELECT column_name, role, use1 AS recommended_use FROM st1")
def initial_recommendation(spark, sf):
    return _candidates(spark, sf).select("column_name", "role", "recommended_use")


@query("family_dedupe", f"WITH {_CAND_SQL} SELECT column_name, measurement_family, use2 AS recommended_use FROM st2")
def family_dedupe(spark, sf):
    return C.drop_family_duplicates(_candidates(spark, sf), 2).select("column_name", "measurement_family", "recommended_use")


def _chosen(spark, sf):
    return C.select_primary(C.drop_family_duplicates(_candidates(spark, sf), 2), 60)


@query("quota_selection", f"WITH {_CAND_SQL} SELECT column_name, role, recommended_use FROM cat")
def quota_selection(spark, sf):
    return _chosen(spark, sf).select("column_name", "role", "recommended_use")


@query("feature_whitelist", f"WITH {_CAND_SQL} SELECT column_name FROM cat WHERE recommended_use = 'include_primary'")
def feature_whitelist(spark, sf):
    return C.whitelist(_chosen(spark, sf))


@query(
    "feature_blacklist",
    f"""WITH {_CAND_SQL} SELECT column_name, CASE recommended_use WHEN 'exclude_leakage' THEN 'Target-derived or temporal field is excluded from model inputs.'
      WHEN 'exclude_identifier' THEN 'Identifier is retained only for joins and subject-level splits.' WHEN 'exclude_administrative' THEN 'Administrative or data-construction field.'
      WHEN 'exclude_unresolved' THEN 'Field meaning or modeling role is not resolved for the primary set.' WHEN 'exclude_high_missing' THEN 'Availability is below the configured feature threshold.'
      ELSE 'A better-covered representative from the same measurement family was retained.' END AS exclusion_reason
    FROM cat WHERE recommended_use LIKE 'exclude_%'""",
)
def feature_blacklist(spark, sf):
    from visitline.functions.states import literal_map

    reasoned = _chosen(spark, sf).withColumn(
        "exclusion_reason", F.try_element_at(literal_map(C.REASONS), F.col("recommended_use"))
    )
    return C.blacklist(reasoned)


@query(
    "role_summary",
    f"""WITH {_CAND_SQL} SELECT role, CAST(count(*) AS BIGINT) AS total_columns, min(missing_rate) AS best_missing_rate,
      CAST(count(*) FILTER (WHERE recommended_use IN ('include_primary', 'include_optional')) AS BIGINT) AS eligible,
      CAST(count(*) FILTER (WHERE recommended_use = 'include_primary') AS BIGINT) AS primary FROM cat GROUP BY 1""".replace("AS primary ", 'AS "primary" '),
)
def role_summary(spark, sf):
    return C.role_summary(_chosen(spark, sf))


@query(
    "catalog_totals",
    f"""WITH {_CAND_SQL} SELECT CAST(count(*) AS BIGINT) AS columns, CAST(count(*) FILTER (WHERE dictionary_match) AS BIGINT) AS dictionary_matches,
      CAST(count(*) FILTER (WHERE recommended_use = 'include_primary') AS BIGINT) AS primary_features FROM cat""",
)
def catalog_totals(spark, sf):
    return C.catalog_summary(_chosen(spark, sf))


@query(
    "exclusion_counts",
    f"WITH {_CAND_SQL} SELECT recommended_use AS rule, CAST(count(*) AS BIGINT) AS columns FROM cat WHERE recommended_use LIKE 'exclude_%' GROUP BY 1",
)
def exclusion_counts(spark, sf):
    return C.exclusion_counts(_chosen(spark, sf))


@query(
    "feature_group_lookup",
    f"""WITH {_CAND_SQL} SELECT role, string_agg(column_name, '|' ORDER BY column_name) AS features FROM cat WHERE recommended_use = 'include_primary' GROUP BY 1""",
)
def feature_group_lookup(spark, sf):
    chosen = _chosen(spark, sf)
    return C.feature_group_table(chosen, C.whitelist(chosen)).select("role", F.array_join("features", "|").alias("features"))


@query(
    "name_difference",
    f"""WITH {_CAND_SQL} SELECT column_name FROM cat WHERE recommended_use = 'include_primary' EXCEPT SELECT column_name FROM cat WHERE dictionary_match""",
)
def name_difference(spark, sf):
    chosen = _chosen(spark, sf)
    return C.whitelist(chosen).exceptAll(chosen.where("dictionary_match").select("column_name"))


@query(
    "suspicious_top_features",
    f"""WITH {_ROLE_SQL}, imp AS (SELECT column_name AS feature, CAST(sum(p_partkey) AS DOUBLE) AS importance FROM named GROUP BY 1),
    head AS (SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 20)
    SELECT feature, importance FROM head WHERE feature IN ('RID', 'DX', 'DXCHANGE', 'VISCODE') OR regexp_matches(upper(feature), '^(SITE|COLPROT|ORIGPROT|EXAMDATE)')""",
)
def suspicious_top_features(spark, sf):
    importance = _named_parts(spark, sf).groupBy(F.col("column_name").alias("feature")).agg(
        F.sum("p_partkey").cast("double").alias("importance")
    )
    return C.suspicious_top_features(importance)


# --- whole catalog of a wide table -------------------------------------------------------------

_WIDE = {
    "RID": "subject", "VISCODE": "visit_code", "EXAMDATE": "visit_date", "DX": "state", "DX_bl": "state",
    "AGE": "balance", "PTGENDER": "segment", "MMSE": "spend", "MMSE_bl": "balance", "SITE": "segment",
    "Hippocampus_UCSFFSX_11_02_15": "spend", "Hippocampus_UCSFFSL_02_01_14": "balance", "FDG": "balance",
    "ABETA_UPENNBIOMK9_04_19_17": "csf", "AV45": "rare", "Ventricles": "spend", "APOE4": "priority", "mystery": "row_id",
}
_ENTRIES = [
    ("fldname", "TBLNAME", "TEXT", "TYPE", "UNITS", 0), ("age", "ADNIMERGE", "Age", "N", "years", 1), ("AGE", "ADNIMERGE", "", "", "", 2),
    ("MMSE", "ADNIMERGE", "MMSE total", "N", "", 3), ("Ventricles", "ADNIMERGE", "", "N", "", 4),
    ("ABETA_UPENNBIOMK9_04_19_17", "UPENNBIOMK9", "CSF", "N", "pg/ml", 5), ("SITE", "ADNIMERGE", "Site", "", "", 6),
    ("Hippocampus_UCSFFSX_11_02_15", "UCSFFSX", "volume", "N", "mm3", 7),
]
_DICT_VALUES = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in e) + ")" for e in _ENTRIES)
_SCORING = ["AGE", "MMSE_bl", "PTGENDER"]


def _wide_case() -> str:
    return _CASCADE_SQL


_BUILD_SQL = f"""WITH {VISITS_SQL}, extra AS (SELECT *, CASE WHEN state = 'P' THEN spend END AS csf, CASE WHEN spend > 480000 THEN spend END AS rare FROM visits),
 prof AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 1 - count({s}) / CAST(count(*) AS DOUBLE) AS mr, CAST(count({s}) AS BIGINT) AS cnt, CAST(count(DISTINCT {s}) AS BIGINT) AS uniq FROM extra"
    for c, s in _WIDE.items())}),
 dict AS (SELECT * FROM (VALUES {_DICT_VALUES}) t(f, tb, tx, ty, un, pos)),
 dx AS (SELECT *, row_number() OVER (PARTITION BY lower(f) ORDER BY (tb <> '')::INT + (tx <> '')::INT + (ty <> '')::INT + (un <> '')::INT DESC, pos) AS rn FROM dict WHERE upper(f) <> 'FLDNAME'),
 m AS (SELECT prof.*, f IS NOT NULL AS dm, coalesce(tb, '') AS source, coalesce(tx, '') AS description, coalesce(ty, '') AS ty, coalesce(un, '') AS un
   FROM prof LEFT JOIN (SELECT * FROM dx WHERE rn = 1) ON lower(column_name) = lower(f)),
 prep AS (SELECT *, upper(column_name) AS n, upper(source) AS src, upper(column_name || ' ' || source || ' ' || description) AS txt,
   CASE WHEN upper(column_name) <> 'DX_BL' THEN regexp_replace(upper(column_name), '_BL$', '') ELSE upper(column_name) END AS base FROM m),
 r AS (SELECT *, {_CASCADE_SQL} AS role, regexp_replace(regexp_replace(n, '_(UCSFFSL|UCSFFSX|BAIPETNMRC|UCBERKELEYAV45|UCBERKELEYAV1451|DTIROI|UPENNBIOMK).*$', ''), '_BL$', '') AS fam,
   column_name IN ('AGE', 'MMSE_bl', 'PTGENDER') AS avail FROM prep),
 s1 AS (SELECT *, CASE WHEN role IN ('label','baseline_diagnosis','visit_time') THEN 'exclude_leakage' WHEN role = 'identifier' THEN 'exclude_identifier' WHEN role = 'administrative' THEN 'exclude_administrative'
   WHEN role IN ('unknown','medication','medical_history') THEN 'exclude_unresolved' WHEN mr > 0.7 OR cnt < 100 THEN 'exclude_high_missing' ELSE 'include_optional' END AS u1 FROM r),
 s2 AS (SELECT *, CASE WHEN u1 = 'include_optional' AND row_number() OVER (PARTITION BY fam, u1 = 'include_optional' ORDER BY avail DESC, round(mr, 6), dm DESC, column_name) > 1 THEN 'exclude_duplicate'
   WHEN u1 = 'include_optional' THEN 'include_primary' ELSE u1 END AS u2 FROM s1)
 SELECT column_name, dm AS dictionary_match, source AS source_table, description, ty AS type, un AS units, round(mr, 6) AS missing_rate, cnt AS non_missing_count, uniq AS unique_count,
   avail AS available_in_scoring, role, u2 AS recommended_use, role IN ('label', 'baseline_diagnosis') AS suspected_label,
   role IN ('identifier','visit_time','label','baseline_diagnosis','administrative') AS suspected_leakage, fam AS measurement_family,
   CASE u2 WHEN 'exclude_leakage' THEN 'Target-derived or temporal field is excluded from model inputs.' WHEN 'exclude_identifier' THEN 'Identifier is retained only for joins and subject-level splits.'
     WHEN 'exclude_administrative' THEN 'Administrative or data-construction field.' WHEN 'exclude_unresolved' THEN 'Field meaning or modeling role is not resolved for the primary set.'
     WHEN 'exclude_high_missing' THEN 'Availability is below the configured feature threshold.' WHEN 'exclude_duplicate' THEN 'A better-covered representative from the same measurement family was retained.' ELSE '' END AS exclusion_reason FROM s2"""


@query("feature_catalog", _BUILD_SQL)
def feature_catalog(spark, sf):
    rows = visits(spark, sf).withColumns(
        {"csf": F.when(F.col("state") == "P", F.col("spend")), "rare": F.when(F.col("spend") > 480000, F.col("spend"))}
    )
    wide = rows.select(*[F.col(s).alias(c) for c, s in _WIDE.items()])
    entries = spark.createDataFrame(_ENTRIES, "FLDNAME string, TBLNAME string, TEXT string, TYPE string, UNITS string, position int")
    return rounded(C.build_catalog(wide, entries, "position", scoring_columns=_SCORING))


# --- cohort report -----------------------------------------------------------------------------


@query(
    "class_counts",
    f"WITH {VISITS_SQL} SELECT state AS label, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT subject) AS BIGINT) AS subjects FROM visits GROUP BY 1",
)
def class_counts(spark, sf):
    return C.class_counts(bare_visits(spark, sf), "state", "subject")


@query(
    "group_availability",
    f"""WITH {VISITS_SQL} SELECT 'money' AS feature_group, CAST(count(DISTINCT subject) FILTER (WHERE balance IS NOT NULL) AS BIGINT) AS available_subjects, CAST(1 AS INTEGER) AS features FROM visits
    UNION ALL SELECT 'profile', CAST(count(DISTINCT subject) FILTER (WHERE priority IS NOT NULL OR segment IS NOT NULL) AS BIGINT), CAST(2 AS INTEGER) FROM visits""",
)
def group_availability(spark, sf):
    return C.group_availability(visits(spark, sf), "subject", {"money": ["balance"], "profile": ["priority", "segment"]})


@query(
    "cohort_exclusions",
    f"""WITH {VISITS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN lower(trim(visit_code)) = 'bl' THEN 0 ELSE 1 END, visit_date, row_id) AS rn FROM visits),
    s AS (SELECT *, CASE WHEN state = 'P' THEN NULL ELSE state END AS st FROM b WHERE rn = 1)
    SELECT CAST(count(DISTINCT subject) FILTER (WHERE st IS NOT NULL) AS BIGINT) AS included_subjects, CAST(count(st) AS BIGINT) AS included_visits,
      CAST((SELECT count(DISTINCT subject) FROM visits) AS BIGINT) AS source_subjects, CAST(count(*) - count(st) AS BIGINT) AS invalid_or_missing_state_rows FROM s""",
)
def cohort_exclusions(spark, sf):
    rows = visits(spark, sf)
    picked = W.baseline_records(rows, "subject", "visit_code", "visit_date", "row_id")
    known = picked.withColumn("state", F.when(F.col("state") != "P", F.col("state")))
    return C.cohort_exclusions(rows, known, "subject")


@query(
    "sparse_group_cohort",
    f"""WITH {VISITS_SQL}, sp AS (SELECT *, CASE WHEN spend > 420000 THEN spend END AS f1, CASE WHEN spend > 460000 THEN balance END AS f2 FROM visits),
    co AS (SELECT * FROM sp WHERE f1 IS NOT NULL OR f2 IS NOT NULL)
    SELECT CAST(count(DISTINCT subject) AS BIGINT) AS available_subjects, CAST(count(*) AS BIGINT) AS available_visits, CAST(count(DISTINCT subject) AS BIGINT) AS main_cohort_intersection,
      round(avg(((f1 IS NULL)::INT + (f2 IS NULL)::INT) / CAST(2 AS DOUBLE)), 6) AS mean_feature_missing_rate, CAST((SELECT count(DISTINCT subject) FROM visits) AS BIGINT) AS main_cohort_subjects,
      CAST(2 AS INTEGER) AS feature_count, CASE WHEN count(DISTINCT subject) >= 300 AND count(DISTINCT state) = 3 THEN 'Potentially useful as a separate cohort with dedicated validation.'
       WHEN count(DISTINCT subject) >= 100 AND count(DISTINCT state) >= 2 THEN 'Exploratory only; cohort size or class coverage limits robust comparison.'
       ELSE 'Insufficient for a reliable standalone three-class experiment.' END AS modeling_value FROM co""",
)
def sparse_group_cohort(spark, sf):
    rows = visits(spark, sf).withColumns(
        {"f1": F.when(F.col("spend") > 420000, F.col("spend")), "f2": F.when(F.col("spend") > 460000, F.col("balance"))}
    )
    return rounded(C.sparse_group_cohort(rows, ["f1", "f2"], "subject", "state", "visit_code", "visit_date", "row_id"))


@query(
    "feature_missingness",
    f"WITH {VISITS_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS missing_rate FROM visits" for c in FEATURES
    ),
)
def feature_missingness(spark, sf):
    return rounded(C.missing_rates(visits(spark, sf), FEATURES).orderBy(F.desc("missing_rate")))


@query(
    "group_subject_coverage",
    f"WITH {VISITS_SQL} SELECT segment, CAST(count(*) FILTER (WHERE priority IS NOT NULL OR balance IS NOT NULL) AS BIGINT) AS covered FROM visits GROUP BY 1",
)
def group_subject_coverage(spark, sf):
    return visits(spark, sf).groupBy("segment").agg(F.count_if(any_available(["priority", "balance"])).alias("covered"))
