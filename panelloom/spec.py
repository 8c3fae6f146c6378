"""Column roles of a panel table and the fixed names of the agroforestry preset."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelSpec:
    """Names the roles of a panel's columns.

    ``order`` lists extra columns which, after ``period``, make the row order
    within an entity total; "first" and "last" always mean first and last in
    ``(period, *order)``.
    """

    entity: str
    period: str
    category: str | None = None
    order: tuple[str, ...] = ()

    @property
    def ordering(self) -> tuple[str, ...]:
        return (self.period, *self.order)


# --- Fixed values: column names, labels and thresholds that inputs and results
# --- must carry for results to be comparable.
TEMPORAL = ["Harvest_Year_Absolute"]
CLIMATE_SUM = ["GDD_cycle_AF", "ETP_cycle_AF", "precipitation_AF", "globalRadiation_AF"]
CLIMATE_MEAN = ["frost_events_cycle_AF", "maxTemperature_extreme_AF", "minTemperature_extreme_AF"]
CLIMATE = [
    "GDD_cycle_AF", "ETP_cycle_AF", "precipitation_AF", "frost_events_cycle_AF",
    "globalRadiation_AF", "maxTemperature_extreme_AF", "minTemperature_extreme_AF",
]
GEO = ["latitude"]
DESIGN = ["plotWidth", "plotHeight", "strip_width", "northOrientation", "Rotation"]
DESIGN_B2 = ["plotWidth", "plotHeight"]
SOIL = ["soilDepth", "sand", "clay", "stone", "waterTable", "w_peak_doy", "w_amp", "w_mean"]
SOIL_B2 = ["soilDepth", "sand", "clay", "stone", "waterTable"]
CATEGORICAL = ["main_crop", "period", "w_type"]
CATEGORICAL_B2 = ["main_crop", "w_type"]
CROP_BASES = ["yield", "grainBiomass", "biomass"]
TREE_BASES = ["carbonStem", "carbonBranches", "carbonCoarseRoots"]
STOCK_TARGETS = [
    "yield_AF", "yield_TA", "biomass_AF", "biomass_TA", "grainBiomass_AF", "grainBiomass_TA",
    "carbonStem_AF", "carbonStem_TF", "carbonBranches_AF", "carbonBranches_TF",
    "carbonCoarseRoots_AF", "carbonCoarseRoots_TF",
]
CURVE_TARGETS = ["carbonStem_AF", "carbonStem_TF", "yield_AF", "yield_TA"]
NA_KEY_COLUMNS = ["yield_AF", "yield_TA", "carbonStem_AF", "carbonStem_TF", "biomass_AF"]
FRACTION_PATTERNS = ["Stress", "stress", "relativeTotalParIncident"]
NONNEGATIVE_PATTERNS = [
    "yield_", "grainBiomass_", "biomass_", "carbonStem_", "carbonBranches_",
    "carbonCoarseRoots_", "carbonStump_", "carbonFineRoots_", "carbonFruit_",
    "totalLeafArea_", "tree_dbh_", "tree_height_", "density_", "plotWidth", "plotHeight",
    "strip_width", "waterUptake", "waterDemand", "precipitation", "irrigation", "ETP_cycle",
    "GDD_cycle", "globalRadiation", "soilDepth", "sand", "clay", "stone",
]
NEVER_INTERPOLATE_PATTERNS = ["yield_", "grainBiomass_", "biomass_", "_eff_", "_delta_", "RR_", "LER_"]
NEVER_WINSORIZE_PATTERNS = [
    "RR_", "LER_", "_eff_", "_delta_", "latitude", "longitude", "sand", "clay", "stone",
    "soilDepth", "plotWidth", "plotHeight", "strip_width",
]
POPULATIONS_6 = [
    "yield_ok × tree_ok", "yield_ok × tree_stunted", "yield_ok × tree_failed",
    "yield_fail × tree_ok", "yield_fail × tree_stunted", "yield_fail × tree_failed",
]
POPULATIONS_4 = [
    "yield_ok × tree_ok", "yield_ok × tree_degraded",
    "yield_fail × tree_ok", "yield_fail × tree_degraded",
]
NOMINAL = "yield_ok × tree_ok"
TREE_FAIL, TREE_STUNT = 1.0, 50.0
YIELD_FAIL, YIELD_FAIL_RATE = 0.5, 0.5
STUNTED_PROBABILITY = 0.30
GEO_LATITUDE, GEO_LONGITUDE = 44.0, 3.5
MIN_MINORITY = 80
HORIZONS = [5, 10, 20, 30, 40]
ENRICH_AFTER = 10
RECENT_WINDOW = 5
N_YEARS = 40
RATIO_FLOOR = 0.001
TREE_CLASSIFIER_FEATURES = [
    "clay", "sand", "stone", "latitude", "plotHeight", "plotWidth", "soilDepth", "main_crop", *CLIMATE,
]
YIELD_CLASSIFIER_FEATURES = [
    "latitude", "clay", "waterTable", "sand", "stone", "soilDepth", *CLIMATE,
]
FIXED_PLAN_PARAMETERS = {
    "northOrientation": 90, "strip_width": 3, "rotation": False, "period": "FUT",
    "w_amp": 4.0, "w_mean": -7.0, "w_peak_doy": 60,
}
SWEEP_BOUNDS = {
    "plotWidth": (4.0, 24.0), "plotHeight": (6.0, 30.0), "soilDepth": (0.5, 8.0),
    "sand": (10.0, 80.0), "clay": (5.0, 50.0), "GDD_cycle_AF": (800.0, 2500.0),
    "precipitation_AF": (300.0, 1200.0), "latitude": (41.0, 51.0),
}
TARGET_UNITS = {
    "carbonStem_AF": "kgC/tree", "carbonStem_TF": "kgC/tree", "yield_AF": "t/ha", "yield_TA": "t/ha",
}
QUALITY_THRESHOLDS = {
    "clf1_f1_macro": 0.70, "clf1_roc_auc": 0.80, "clf2_accuracy": 0.85, "carbon_r2": 0.60,
    "carbon_rho": 0.80, "yield_af_r2": 0.55, "yield_ta_r2": 0.55,
}
# --- End of fixed values.


def prefilter_features(features: list[str]) -> list[str]:
    """Feature list with the whole climate block replaced by ``longitude``."""
    at = next((i for i, f in enumerate(features) if f in CLIMATE), None)
    kept = [f for f in features if f not in CLIMATE]
    return kept if at is None else [*kept[:at], "longitude", *kept[at:]]


ACTIVE_FEATURES_B2 = TEMPORAL + GEO + CLIMATE + DESIGN_B2 + SOIL_B2 + CATEGORICAL_B2
PLAN_FEATURES_B1 = GEO + DESIGN + SOIL + CATEGORICAL
STAGE2_AF_FEATURES = [*ACTIVE_FEATURES_B2, "carbonStem_AF"]
STAGE2_TA_FEATURES = ACTIVE_FEATURES_B2
STATIC_FEATURES_B2 = [f for f in ACTIVE_FEATURES_B2 if f not in CLIMATE and f not in TEMPORAL]
