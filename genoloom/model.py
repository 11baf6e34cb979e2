"""Panels, policies, result codes and errors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from .functions.cells import Packed

# Actions of the allele resolution.
PASSTHROUGH = "passthrough"
REF_ALT_SWAP = "ref_alt_swap"
STRAND_FLIP = "strand_flip"
STRAND_FLIP_AND_SWAP = "strand_flip_and_swap"
FILL_MISSING = "fill_missing"
DROP = "drop"

# Reasons of a drop.
AMBIGUOUS_STRAND = "ambiguous_strand"
ALLELE_MISMATCH = "allele_mismatch"
ON_STRAND_DROP = "on_strand_drop"
ON_MISSING_DROP = "on_missing_drop"

# Keys of the action histogram, in report order.
HISTOGRAM_KEYS = (
    "passthrough",
    "swap",
    "flip",
    "fill_missing",
    "dropped_ambiguous_strand",
    "dropped_allele_mismatch",
    "dropped_on_strand",
    "pre_alignment_filter_dropped",
    "drop",
)

# Compatibility labels of two panels.
EMPTY_INPUT = "empty_input"
COMPATIBLE = "compatible"
KEY_SPACE_MISMATCH = "key_space_mismatch"
BUILD_MISMATCH = "build_mismatch"
DISJOINT_PANELS = "disjoint_panels"

AUTOSOMES = tuple(range(1, 23))
ALL_CHROMOSOMES = tuple(range(1, 27))


class PanelError(Exception):
    """An error with the exit code of its kind."""

    exit_code = 3


class ValidationFailed(PanelError):
    """A quality gate fired."""

    exit_code = 1


class IOFailed(PanelError):
    """A file cannot be read, written or understood."""

    exit_code = 2


class InvariantBroken(PanelError):
    """The data contradict what the operation needs."""

    exit_code = 3


class UsageFailed(PanelError):
    """The options contradict each other or the inputs."""

    exit_code = 4


@dataclass(frozen=True)
class Policy:
    """What to do about each kind of disagreement between panels."""

    variant_key: str = "chr_pos"
    on_mismatch: str = "drop"
    on_missing: str = "fill_missing"
    on_extra: str = "warn"
    on_strand: str = "flip"
    on_collision: str = "error"
    trust_strand: bool = False
    id_column: str = "IID"
    population_column: str | None = None
    target_min_call_rate: float = 0.40
    validate_strand_fail_pct: float = 10.0
    extras_warn_threshold: float = 0.10
    preflight_policy: str = "warn"

    CHOICES = {
        "variant_key": ("chr_pos", "id"),
        "on_mismatch": ("drop", "error"),
        "on_missing": ("fill_missing", "drop_variant", "error"),
        "on_extra": ("warn", "drop", "error"),
        "on_strand": ("flip", "drop", "error"),
        "on_collision": ("error", "first", "suffix"),
        "preflight_policy": ("off", "warn", "strict"),
    }

    def __post_init__(self) -> None:
        for name, choices in self.CHOICES.items():
            if getattr(self, name) not in choices:
                raise UsageFailed(f"{name} must be one of {', '.join(choices)}, not {getattr(self, name)!r}")

    @property
    def keys(self) -> list[str]:
        return ["chrom", "pos"] if self.variant_key == "chr_pos" else ["id"]


@dataclass(frozen=True)
class Panel:
    """A dataset: variants (rows), samples (columns) and dosages.

    variants: row_idx, chrom, pos, id, ref, alt, cm; biallelic SNPs only, with the
    row number that they have among all rows of the source.
    samples: sample_ord and text columns, IID among them.
    dosages: row_idx, g array<tinyint> with an element for each sample, null for
    a missing call; None where only variants are needed.
    packed: the same as :class:`genoloom.functions.cells.Packed`, where there is a
    form with small rows; other dosages take its place.
    """

    variants: DataFrame
    samples: DataFrame | None = None
    dosages: DataFrame | None = None
    path: str = ""
    format: str = "frame"
    is_target: bool = False
    n_raw: int | None = None
    overrides: dict[str, int] = field(default_factory=dict)
    fault: str | None = None  # why the dosages cannot be read with these variants
    packed: Packed | None = None

    def with_(self, **changes) -> Panel:
        return replace(self, **({"packed": None} if "dosages" in changes else {}) | changes)
