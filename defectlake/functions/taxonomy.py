"""Damage label vocabulary as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label alias -> canonical damage label, in matching order.
ALIASES = {
    "crack": "crack", "cracks": "crack", "structural crack": "crack", "structural_crack": "crack",
    "microcrack": "crack", "micro crack": "crack", "microfissure": "crack", "fissure": "crack", "fissura": "crack",
    "net crack": "crack", "net_crack": "crack", "crack candidate": "crack", "crack_candidate": "crack",
    "rust": "corrosion", "rust corrosion": "corrosion", "corrosion": "corrosion", "rebar corrosion": "corrosion",
    "rebar_corrosion": "corrosion", "steel corrosion": "corrosion",
    "spalling": "spalling", "concrete spalling": "spalling", "spall": "spalling",
    "exposed rebar": "exposed_rebar", "exposed reinforcement bar": "exposed_rebar",
    "exposed reinforcement": "exposed_rebar", "rebar exposure": "exposed_rebar", "exposed_rebar": "exposed_rebar",
    "efflorescence": "efflorescence", "precipitation": "efflorescence",
    "water stain": "moisture", "water leakage": "moisture", "water leak": "moisture", "waterleak": "moisture",
    "moisture": "moisture", "damp": "moisture",
    "delamination": "delamination",
    "severe distress": "general_damage", "severe_distress": "general_damage", "concrete damage": "general_damage",
    "damage": "general_damage", "defect": "general_damage", "other": "general_damage",
    "crushing": "crushing", "concrete crushing": "crushing",
}
# Canonical damage label -> display text.
DISPLAY = {
    "crack": "Fissura", "corrosion": "Corrosão", "spalling": "Desplacamento", "exposed_rebar": "Armadura exposta",
    "efflorescence": "Eflorescência", "moisture": "Umidade/Infiltração", "delamination": "Delaminação",
    "crushing": "Esmagamento", "general_damage": "Dano geral",
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean_label(label: Column) -> Column:
    """Trim, lower-case, turn dashes and underscores into spaces, collapse runs of white space."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"^\s+|\s+$", "")
    return F.regexp_replace(F.translate(trimmed, "-_", "  "), r"\s+", " ")


def canonicalize(label: Column) -> Column:
    """Exact alias, else the first alias (in table order) contained in the label, else the label with underscores."""
    text = clean_label(label)
    chain = None
    for alias, canonical in ALIASES.items():
        if "_" in alias:  # cleaned text has no underscore
            continue
        hit = text.contains(alias)
        chain = F.when(hit, canonical) if chain is None else chain.when(hit, canonical)
    other = F.when(text == "", F.lit("unknown")).otherwise(F.replace(text, F.lit(" "), F.lit("_")))
    return F.coalesce(F.element_at(literal_map(ALIASES), text), chain, other)


def display_name(canonical: Column) -> Column:
    """Fixed name, else title case: a letter that follows no letter is a capital, any other is small."""
    text = F.lower(F.replace(canonical, F.lit("_"), F.lit(" ")))
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    title = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    return F.coalesce(F.element_at(literal_map(DISPLAY), canonical), title)
