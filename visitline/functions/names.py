"""Column-name rules: roles, measurement families and name matching."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class RoleRule:
    """A role and the conditions that give it; any one is enough, within ``only_source`` if set.

    ``base`` is the name without a trailing ``_BL``; ``text`` is name, source table and description.
    """

    role: str
    base_is: Sequence[str] = ()
    name_is: Sequence[str] = ()
    name_starts: Sequence[str] = ()
    base_starts: Sequence[str] = ()
    name_has: Sequence[str] = ()
    base_has: Sequence[str] = ()
    text_has: Sequence[str] = ()
    name_matches: Sequence[str] = ()
    source_is: Sequence[str] = ()
    only_source: str | None = None
    prefix_of: Sequence[str] = field(default=())  # name starts with "<item>_"


# Role names, word lists and patterns, in order of precedence.
_IDENTIFIERS = ("RID", "PTID", "LONIUID", "LONISID", "IMAGEUID")
_VISIT_TIMES = ("VISCODE", "VISCODE2", "EXAMDATE", "SCANDATE", "VISDATE", "MONTH_BL", "YEARS_BL")
CSF_PATTERNS = (
    "^ABETA($|_)", "^ABETA42($|_)", "^TAU($|_)", "^PTAU($|_)", "^PTAU181($|_)", "UPENNBIOMK", "ELECSYS",
)
PET_PATTERNS = (
    "^FDG($|_)", "^PIB($|_)", "^AV45($|_)", "AV1451", "FLORBETAPIR", "FLORTAUCIPIR", "SUVR", "CENTILOID",
)
ROLE_RULES = (
    RoleRule("label", base_is=("DX", "DXCHANGE", "DIAGNOSIS")),
    RoleRule("baseline_diagnosis", base_is=("DX_BL",)),
    RoleRule("identifier", base_is=_IDENTIFIERS, prefix_of=_IDENTIFIERS),
    RoleRule("visit_time", name_is=_VISIT_TIMES, base_is=_VISIT_TIMES, prefix_of=_VISIT_TIMES),
    RoleRule(
        "administrative",
        base_is=(
            "D1", "D2", "SITE", "COLPROT", "ORIGPROT", "PHASE", "RUNDATE", "STATUS", "VERSION", "UPDATE_STAMP",
        ),
        name_has=("RUNDATE", "STATUS", "VERSION", "UPDATE_STAMP", "QC", "COMMENT"),
    ),
    RoleRule("csf", source_is=("UPENNBIOMK9",), name_matches=CSF_PATTERNS, text_has=("ELECSYS",)),
    RoleRule("mri_dti", source_is=("DTIROI",), text_has=("DIFFUSION", "DIFFUSIVITY")),
    RoleRule("pet_fdg", source_is=("BAIPETNMRC",), name_starts=("FDG",)),
    RoleRule(
        "pet_amyloid", source_is=("UCBERKELEYAV45",), name_has=("AV45", "PIB", "FLORBETAPIR", "CENTILOID")
    ),
    RoleRule("pet_other", source_is=("UCBERKELEYAV1451",), name_matches=PET_PATTERNS),
    RoleRule(
        "mri_structural",
        source_is=("UCSFFSL", "UCSFFSX"),
        text_has=("FREESURFER", "CORTICAL THICKNESS", "BRAIN VOLUME", "HIPPOCAMP"),
    ),
    RoleRule(
        "demographic",
        base_starts=("AGE", "PTGENDER", "PTEDUCAT", "PTETHCAT", "PTRACCAT", "PTMARRY", "PTDOB"),
    ),
    RoleRule(
        "cognitive",
        base_starts=(
            "ADAS", "MMSE", "RAVLT", "CDR", "FAQ", "LDELT", "TRAB", "CLOCK", "LOGMEM", "CATFLU", "WAISR", "MOCA",
        ),
    ),
    RoleRule("genetic", base_has=("APOE", "APGEN", "GENOTYPE")),
    RoleRule("medication", text_has=("MEDICATION", "DRUG", "PRESCRIPTION")),
    RoleRule("medical_history", text_has=("MEDICAL HISTORY", "FAMILY HISTORY", "HISTORY")),
    RoleRule("biofluid_other", text_has=("PLASMA", "SERUM", "BIOFLUID", "BIOMARKER")),
    RoleRule(
        "mri_structural",
        only_source="ADNIMERGE",
        base_has=("VENTRICLES", "HIPPOCAMPUS", "WHOLEBRAIN", "ENTORHINAL", "FUSIFORM", "MIDTEMP", "ICV"),
    ),
)
# Acquisition suffixes cut from a column name to get its measurement family.
FAMILY_SUFFIX = "_(UCSFFSL|UCSFFSX|BAIPETNMRC|UCBERKELEYAV45|UCBERKELEYAV1451|DTIROI|UPENNBIOMK).*$"


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def column_role(
    name: Column, source: Column, description: Column, rules: Sequence[RoleRule] = ROLE_RULES
) -> Column:
    """Role of a column, first matching rule wins, ``unknown`` otherwise."""
    name = F.upper(name)
    source = F.upper(F.coalesce(source, F.lit("")))
    text = F.concat_ws(" ", name, source, F.upper(F.coalesce(description, F.lit(""))))
    base = F.when(name != "DX_BL", F.regexp_replace(name, "_BL$", "")).otherwise(name)
    role = F.lit("unknown")
    for rule in reversed(rules):
        hit = _any(
            [base.isin(*rule.base_is)] * bool(rule.base_is)
            + [name.isin(*rule.name_is)] * bool(rule.name_is)
            + [source.isin(*rule.source_is)] * bool(rule.source_is)
            + [name.startswith(f"{p}_") for p in rule.prefix_of]
            + [name.startswith(p) for p in rule.name_starts]
            + [base.startswith(p) for p in rule.base_starts]
            + [name.contains(w) for w in rule.name_has]
            + [base.contains(w) for w in rule.base_has]
            + [text.contains(w) for w in rule.text_has]
            + [name.rlike("|".join(rule.name_matches))] * bool(rule.name_matches)
        )
        if rule.only_source:
            hit = hit & (source == rule.only_source)
        role = F.when(hit, rule.role).otherwise(role)
    return role


def measurement_family(name: Column, suffix: str = FAMILY_SUFFIX) -> Column:
    """Upper-cased name without source/date suffix and without a trailing ``_BL``."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), suffix, ""), "_BL$", "")


# --- matchers over an array of column names -----------------------------------------------------


def normalized_name(name: Column) -> Column:
    """Upper case, letters, digits and Greek only."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9Ͱ-Ͽ]", "")


def normalize_text(text: str) -> str:
    return "".join(ch for ch in text.upper() if ch.isascii() and ch.isalnum() or "Ͱ" <= ch <= "Ͽ")


def matching_names(columns: Column, candidates: Sequence[str]) -> Column:
    """Columns equal to a candidate after normalisation, in column order."""
    keys = sorted({normalize_text(c) for c in candidates})
    return F.filter(columns, lambda c: normalized_name(c).isin(*keys))


def prefixed_names(columns: Column, prefixes: Sequence[str], limit: int = 24) -> Column:
    return F.slice(F.filter(columns, lambda c: _any([F.upper(c).startswith(p) for p in prefixes])), 1, limit)


def pattern_names(columns: Column, patterns: Sequence[str]) -> Column:
    return F.filter(columns, lambda c: c.rlike("(?i)" + "|".join(patterns)))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    upper = F.upper(text)
    return _any([upper.contains(w.upper()) for w in words])


def encoded_feature_group(feature: Column, columns: Sequence[tuple[str, str]]) -> Column:
    """Group of an encoded feature name: the first (group, column) it equals or extends, else ``other``.

    ``columns`` are schema-sized (group, column) pairs in priority order.
    """
    clean = F.element_at(F.split(feature, "__"), -1)
    found = F.lit("other")
    for group, col in reversed(columns):
        hit = (clean == col) | clean.startswith(f"{col}_") | clean.startswith(f"{col}=")
        found = F.when(hit, group).otherwise(found)
    return found
