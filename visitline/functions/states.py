"""Clinical state labels: alias normalisation, encoding, transitions and error categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Ordered states and the exact, case-sensitive spellings that stand for each.
STATES = ("CN", "MCI", "AD")
STATE_ALIASES = {
    "CN": "CN",
    "NL": "CN",
    "NL to NL": "CN",
    "MCI to NL": "CN",
    "Dementia to NL": "CN",
    "MCI": "MCI",
    "NL to MCI": "MCI",
    "MCI to MCI": "MCI",
    "Dementia to MCI": "MCI",
    "AD": "AD",
    "Dementia": "AD",
    "NL to Dementia": "AD",
    "MCI to Dementia": "AD",
}
# Additional spellings accepted in outcome tables.
OUTCOME_ALIASES = {
    "CN": "CN",
    "NL": "CN",
    "Normal": "CN",
    "MCI": "MCI",
    "EMCI": "MCI",
    "LMCI": "MCI",
    "AD": "AD",
    "Dementia": "AD",
}


@dataclass(frozen=True)
class StateScheme:
    """Ordered states plus the raw spellings that map onto them."""

    states: tuple[str, ...] = STATES
    aliases: Mapping[str, str] = None

    def lookup(self) -> Mapping[str, str]:
        if self.aliases is not None:
            return self.aliases
        return STATE_ALIASES if self.states == STATES else {s: s for s in self.states}


DEFAULT_SCHEME = StateScheme()
OUTCOME_SCHEME = StateScheme(aliases=OUTCOME_ALIASES)


def literal_map(pairs: Mapping) -> Column:
    flat = [F.lit(v) for pair in pairs.items() for v in pair]
    return F.create_map(*flat)


def normalize_state(raw: Column, scheme: StateScheme = DEFAULT_SCHEME) -> Column:
    """Trimmed exact alias lookup; anything unknown becomes null."""
    return F.try_element_at(literal_map(scheme.lookup()), F.trim(raw.cast("string")))


def encode_state(state: Column, scheme: StateScheme = DEFAULT_SCHEME) -> Column:
    """0-based position of a normalised state."""
    return F.try_element_at(literal_map({s: i for i, s in enumerate(scheme.states)}), state)


def state_name(code: Column, scheme: StateScheme = DEFAULT_SCHEME) -> Column:
    return F.get(F.array(*[F.lit(s) for s in scheme.states]), code.cast("int"))


def build_labels(
    df: DataFrame, label_col: str, task: str = "multiclass", scheme: StateScheme = DEFAULT_SCHEME
) -> DataFrame:
    """Add ``state`` and ``label`` and keep labelled rows.

    ``multiclass`` keeps every state; ``binary`` keeps the first and last state as 0 and 1.
    """
    if label_col not in df.columns:
        raise ValueError(f"Label column not found: {label_col}")
    if task == "multiclass":
        codes = {s: i for i, s in enumerate(scheme.states)}
    elif task == "binary":
        codes = {scheme.states[0]: 0, scheme.states[-1]: 1}
    else:
        raise ValueError(f"Unsupported label task: {task}")
    return (
        df.withColumn("state", normalize_state(F.col(label_col), scheme))
        .withColumn("label", F.try_element_at(literal_map(codes), F.col("state")))
        .where(F.col("label").isNotNull())
    )


def transition(source: Column, future: Column) -> Column:
    return F.concat_ws(" -> ", source, future)


def transition_names(scheme: StateScheme = DEFAULT_SCHEME) -> list[str]:
    return [f"{a} -> {b}" for a in scheme.states for b in scheme.states]


def error_category(truth: Column, predicted: Column, scheme: StateScheme = DEFAULT_SCHEME) -> Column:
    """Category of a misclassified three-state row."""
    first, middle, last = scheme.states
    return (
        F.when((truth == 0) & (predicted == 2), F.lit(f"{first}_predicted_as_{last}"))
        .when((truth == 2) & (predicted == 0), F.lit(f"{last}_predicted_as_{first}"))
        .when((truth == 1) | (predicted == 1), F.lit(f"{middle}_confusion"))
        .otherwise(F.lit("other_error"))
    )


def error_groups(
    source: Column, future: Column, predicted: Column, scheme: StateScheme = DEFAULT_SCHEME
) -> dict[str, Column]:
    """The four audited transition-error predicates over normalised state names."""
    first, middle, last = scheme.states
    return {
        f"{middle}_to_{last}_missed_conversions": (source == middle) & (future == last) & (predicted != last),
        f"{middle}_to_{middle}_false_progression": (source == middle) & (future == middle) & (predicted == last),
        f"{first}_progression_missed": (source == first) & future.isin(middle, last) & (predicted == first),
        f"{last}_non_{last}_reversions": (source == last) & (future != last),
    }


def outcome_label_audit(df: DataFrame, raw_col: str, scheme: StateScheme = OUTCOME_SCHEME) -> DataFrame:
    """Row count per raw outcome spelling with its normalised state (null = unresolved)."""
    return (
        df.groupBy(F.col(raw_col).alias("raw_label"))
        .agg(F.count("*").alias("count"))
        .withColumn("normalized_label", normalize_state(F.col("raw_label"), scheme))
    )


def check_states(present: Sequence[str], scheme: StateScheme) -> None:
    unknown = sorted(set(present) - set(scheme.states))
    if unknown:
        raise ValueError(f"Unknown states: {', '.join(unknown)}")
