"""Iron and acid chemistry of one water volume as column expressions; amounts in mol, volumes in litres."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.bounds import at_least, at_most

# fixed values of the kinetics and equilibria
K_FERRIC = 10.0**-9.74 * 1e4 / 60.0
K_OXYGEN = 10.0**-8.19
K1_OXIDATION, K2_OXIDATION = 1.33e12, 2.91e-9
OXYGEN_PRESSURE = 0.21
WATER = 1.0e-14
SOLUBILITY = 7.762471e4
DISSOLVED_OXYGEN = 10 / 31998
# fixed values: molar masses in mg/mol
MOLAR_MG = {"ferrous_iron": 55845.0, "ferric_iron": 55845.0, "sulphate": 96056.0, "hydrogen_ion": 1008.0, "ferric_oxyhydroxide": 106870.0, "bedload_storage": 106870.0}
#: Iron in a mass of ferric oxyhydroxide.
IRON_PART = 55.845 / 106.87


def micrograms(mol: Column, litres: Column, species: str) -> Column:
    """Concentration in microgram per litre; NULL without water."""
    return mol / F.nullif(litres, F.lit(0.0)) * MOLAR_MG[species] * 1000


def moles_per_litre(micrograms_per_litre: Column, species: str) -> Column:
    """Concentration in mol/L from microgram per litre."""
    return micrograms_per_litre / (MOLAR_MG[species] * 1000)


def ph(h: Column) -> Column:
    """pH of a hydrogen concentration in mol/L, NULL at 0 and below."""
    return F.when(h > 0, -F.log10(at_least(h, 1e-14)))


def dissolved_iron(ferrous: Column, ferric: Column) -> Column:
    """Fe-Dis in mass units; NULL if a part is."""
    return ferrous + ferric


def total_iron(ferrous: Column, ferric: Column, oxyhydroxide: Column) -> Column:
    """Fe-Tot in mass units; the oxyhydroxide counts with its iron."""
    return ferrous + ferric + oxyhydroxide * IRON_PART


def activities(h: Column, fe3: Column, fe2: Column, so4: Column) -> tuple[Column, Column]:
    """Davies activity coefficients of hydrogen and ferric ions at concentrations in mol/L."""
    strength = at_most(0.5 * (h + 9 * fe3 + 4 * fe2 + 4 * so4), 1.0)
    root = F.sqrt(strength)
    d = root / (1 + root) - 0.3 * strength
    return F.pow(F.lit(10.0), -0.5 * d), F.pow(F.lit(10.0), -4.5 * d)


def ferric_at_equilibrium(h: Column, fe3: Column, fe2: Column, so4: Column) -> Column:
    """Ferric iron in mol/L in equilibrium with its hydroxide; inputs in mol/L."""
    acid = at_least(h, 1e-14)
    of_h, of_fe3 = activities(acid, at_least(fe3, 0.0), at_least(fe2, 0.0), at_least(so4, 0.0))
    active = of_h * acid
    return SOLUBILITY * active * active * active / of_fe3


def precipitate(fe3: Column, h: Column, suspended: Column, bedload: Column, target: Column) -> dict[str, Column]:
    """Amounts after ferric iron went to `target` (mol): surplus precipitates, a deficit dissolves.

    Dissolving takes suspended hydroxide first, then bedload, each as far as a third of the acid allows.
    """
    surplus = F.least(at_least(fe3 - target, 0.0), fe3)
    need = at_least(target - fe3, 0.0)
    first = F.least(need, at_least(suspended, 0.0), at_least(h / 3, 0.0))
    acid = at_least(h - 3 * first, 0.0)
    second = F.least(need - first, at_least(bedload, 0.0), acid / 3)
    saturated = fe3 > target
    return {
        "ferric_iron": F.when(saturated, fe3 - surplus).otherwise(fe3 + first + second),
        "hydrogen_ion": F.when(saturated, h + 3 * surplus).otherwise(at_least(acid - 3 * second, 0.0)),
        "ferric_oxyhydroxide": F.when(saturated, suspended + surplus).otherwise(suspended - first),
        "bedload_storage": F.when(saturated, bedload).otherwise(bedload - second),
    }


def oxidation_rate(h: Column) -> Column:
    """First-order rate of ferrous oxidation per second at hydrogen concentration h (mol/L)."""
    hydroxyl = WATER / at_least(h, 1e-14)
    return K2_OXIDATION * OXYGEN_PRESSURE + K1_OXIDATION * hydroxyl * hydroxyl * OXYGEN_PRESSURE


def oxidise(fe2: Column, fe3: Column, h: Column, rate: Column, seconds: float) -> dict[str, Column]:
    """Amounts after `seconds` of ferrous oxidation. Ferric gain is bounded by the acid, ferrous loss is not."""
    left = fe2 * F.exp(-rate * seconds)
    made = F.least(fe2 - left, h)
    return {"ferrous_iron": left, "ferric_iron": fe3 + made, "hydrogen_ion": at_least(h - made, 0.0)}


def pyrite_rates(fe3: Column, h: Column, ore: Column, oxygen: float = DISSOLVED_OXYGEN) -> tuple[Column, Column]:
    """Pyrite oxidation by ferric iron and by oxygen in mol/s over `ore` m2; fe3 and h in mol/L."""
    acid = at_least(h, 1e-7)
    by_iron = F.when((fe3 > 0) & (ore > 0), K_FERRIC * F.sqrt(at_least(fe3, 1e-10)) / F.sqrt(acid) * ore).otherwise(F.lit(0.0))
    by_oxygen = F.when(ore > 0, K_OXYGEN * oxygen**0.5 / F.pow(acid, F.lit(0.11)) * ore).otherwise(F.lit(0.0))
    return by_iron, by_oxygen


def ore_area(is_mine: Column, oxidation_range: float = 27.0, factor: float = 1e-3) -> Column:
    """Reactive ore surface of a mine cell in m2, NULL elsewhere."""
    return F.when(is_mine, F.lit(oxidation_range * 1000 * factor))


def impact_class(iron: Column) -> Column:
    """Impact of dissolved iron in microgram per litre: 0..16 low, ..41 raised, above high; NULL at 0 and below."""
    return F.when(iron <= 0, None).when(iron < 16, "low").when(iron < 41, "raised").when(iron < 1e8, "high")
