"""Damage severity and condition rating formulas as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp
from .taxonomy import literal_map

# Damage families in reporting order, weights Fp, relevance Fr and class texts.
FAMILIES = ["cracks", "spalling_dark", "exposed_rebar", "corrosion_rust", "efflorescence_white"]
FP = {"cracks": 3.0, "spalling_dark": 4.0, "exposed_rebar": 5.0, "corrosion_rust": 5.0, "efflorescence_white": 2.0}
FAMILY_FR = {"barreiras_guarda_corpo_pista": 1.0, "juntas_dilatacao": 2.0, "transversinas_cortinas_alas": 3.0,
             "lajes_vigas_secundarias_apoios": 4.0, "vigas_pilares_principais": 5.0}
CLASS_LABELS = {"cracks": "Fissuras", "spalling_dark": "Desplacamento/região escura", "exposed_rebar": "Armadura exposta",
                "corrosion_rust": "Corrosão aparente", "efflorescence_white": "Eflorescência/região clara",
                "growth": "Crescimento entre inspeções", "reduction": "Redução/ausência na inspeção atual"}
EC_LABELS = {4: "Bom", 3: "Razoável", 2: "Ruim", 1: "Severo"}
NT_LABELS = {5: "Excelente/sem dano detectado", 4: "Boa", 3: "Regular", 2: "Ruim", 1: "Crítica", 0: "Emergencial"}
ENVIRONMENT = {"high": 1.10, "moderate": 1.00, "low": 0.95}
# Area-ratio steps -> damage factor Fi, the last factor applies above all steps.
AREA_STEPS = {
    "spalling_dark": ([(0.0005, 1.0), (0.0030, 2.0), (0.0150, 3.0)], 4.0),
    "exposed_rebar": ([(0.0002, 2.0), (0.0015, 3.0)], 4.0),
    "corrosion_rust": ([(0.0005, 1.0), (0.0030, 2.0), (0.0150, 3.0)], 4.0),
    "efflorescence_white": ([(0.0010, 1.0), (0.0100, 2.0)], 3.0),
}
# Crack steps (width limit in mm, width limit in px, density limit, Fi).
CRACK_STEPS = [(0.20, 2.0, 0.05, 1.0), (0.40, 4.0, 0.12, 2.0), (1.00, 8.0, 0.30, 3.0)]
# Area ratio at which the severity of a family saturates.
SATURATION = {"spalling_dark": 0.0150, "exposed_rebar": 0.0015, "corrosion_rust": 0.0150, "efflorescence_white": 0.0100}
# Deterioration index bands.
GDE_BANDS = [(15, "Baixo", "Estado aceitável; manutenção preventiva."),
             (50, "Médio", "Planejar nova inspeção e intervenção em longo prazo."),
             (80, "Alto", "Planejar inspeção especializada e intervenção em médio prazo."),
             (100, "Sofrível", "Inspeção especializada rigorosa e intervenção em curto prazo.")]
GDE_TOP = ("Crítico", "Inspeção especializada imediata e medidas emergenciais.")


@dataclass(frozen=True)
class RatingConfig:
    environment: str = "moderate"
    taus: tuple[float, float, float] = (0.25, 0.50, 0.75)
    recurrence_threshold: int = 5
    extension_threshold: float = 0.015
    critical_weight: float = 4.0
    relevance: float = 4.0
    element_family: str = "lajes_vigas_secundarias_apoios"
    allow_emergency: bool = False
    excluded: tuple[str, ...] = ()
    min_area: float = 30.0
    min_aspect: float = 2.0

    @property
    def fr(self) -> float:
        return self.relevance if self.relevance > 0 else FAMILY_FR.get(self.element_family, 4.0)


def resolve_scale(mode: Column, mm_per_px: Column, reference_px: Column, reference_mm: Column) -> Column:
    """Millimetres per pixel from the manual value or a reference length, null without calibration."""
    return (F.when((mode == "manual_mm_per_px") & (mm_per_px > 0), mm_per_px)
            .when((mode == "reference_length") & (reference_px > 0) & (reference_mm > 0),
                  reference_mm / F.nullif(reference_px, F.lit(0.0))))


def damage_factor(cls: Column, area_ratio: Column, length_px: Column, width_px: Column, mm_per_px: Column,
                  reference_area: Column) -> Column:
    """Damage factor Fi by class from area ratio, or for cracks from width and density."""
    density = length_px / F.greatest(F.sqrt(F.greatest(reference_area, F.lit(1.0))), F.lit(1.0))
    width_mm = width_px * mm_per_px
    crack = None
    for mm, px, limit, fi in CRACK_STEPS:
        fits = F.when(width_mm.isNotNull(), width_mm <= mm).otherwise(width_px <= px) & (density <= limit)
        crack = F.when(fits, fi) if crack is None else crack.when(fits, fi)
    out = F.when(cls == "cracks", crack.otherwise(4.0))
    for name, (steps, top) in AREA_STEPS.items():
        step = None
        for limit, fi in steps:
            step = F.when(area_ratio <= limit, fi) if step is None else step.when(area_ratio <= limit, fi)
        out = out.when(cls == name, step.otherwise(top))
    return out.otherwise(0.0)


def damage_weight(cls: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(FP), cls), F.lit(1.0))


def damage_index(fi: Column, fp: Column) -> Column:
    return (F.when((fi <= 0) | (fp <= 0), 0.0).when(fi <= 2.0, 0.8 * fi * fp).otherwise((12.0 * fi - 28.0) * fp))


def severity(cls: Column, area_ratio: Column, length_px: Column, width_px: Column, mm_per_px: Column,
             reference_area: Column, environment: str = "moderate") -> Column:
    """Continuous severity in [0, 1]."""
    one = F.lit(1.0)
    density = length_px / F.greatest(F.sqrt(F.greatest(reference_area, one)), one)
    width = F.coalesce(width_px * mm_per_px / 1.0, width_px / 8.0)
    out = F.when(cls == "cracks", 0.65 * F.least(one, width) + 0.35 * F.least(one, density / 0.30))
    for name, at in SATURATION.items():
        value = F.least(one, area_ratio / at)
        out = out.when(cls == name, F.greatest(F.lit(0.35), value) if name == "exposed_rebar" else value)
    return clamp(out.otherwise(0.0) * ENVIRONMENT.get(environment, 1.0), 0, 1)


def ordinal_rank(s: Column, taus=(0.25, 0.50, 0.75)) -> Column:
    rank = F.lit(1)
    for tau in sorted(taus):
        rank = rank + (s >= tau).cast("int")
    return rank.cast("long")


def ec_from_rank(rank: Column) -> Column:
    """Condition state 4 (good) to 1 (severe) of an ordinal rank; rank 0 (no damage) is 4."""
    return F.when(rank <= 0, F.lit(4)).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.lit(5) - rank))).cast("long")


def ec_label(ec: Column) -> Column:
    return F.element_at(literal_map(EC_LABELS), ec.cast("int"))


def extension_delta(n: Column, area_ratio: Column, cfg: RatingConfig) -> Column:
    """1 when damage recurs or extends beyond the configured limits."""
    return ((n >= max(1, cfg.recurrence_threshold)) | (area_ratio >= max(0.0, cfg.extension_threshold))).cast("long")


def gde_band(gde: Column) -> tuple[Column, Column]:
    level = action = None
    for limit, name, text in GDE_BANDS:
        hit = gde <= limit
        level = F.when(hit, name) if level is None else level.when(hit, name)
        action = F.when(hit, text) if action is None else action.when(hit, text)
    return level.otherwise(GDE_TOP[0]), action.otherwise(GDE_TOP[1])


def gde_value(d_max: Column, d_sum: Column) -> Column:
    return F.when(d_sum > 0, d_max * (1 + (d_sum - d_max) / F.nullif(d_sum, F.lit(0.0)))).otherwise(0.0)


def structure_rank(rank: Column, critical: bool) -> Column:
    """Element rank as used for the condition note: non-critical elements may gain one level, never hiding a severe state."""
    if critical:
        return rank
    return F.when(rank <= 0, rank).when(rank < 4, F.greatest(F.lit(1).cast("long"), rank - 1)).otherwise(F.lit(3).cast("long"))


def nt_label(nt: Column) -> Column:
    return F.element_at(literal_map(NT_LABELS), nt.cast("int"))


def source_class(damage_class: Column, time_label: Column) -> Column:
    """Base class of a growth or reduction record, taken from its time label."""
    prefix = F.concat(damage_class, F.lit("_"))
    return F.when(damage_class.isin("growth", "reduction") & F.startswith(time_label, prefix),
                  F.substr(time_label, F.length(prefix) + 1)).otherwise(damage_class)
