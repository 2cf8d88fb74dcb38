"""Parameters of every step in one frozen record; scenarios replace some of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: km/h by road class, from fast to slow.
ROAD_SPEEDS = {"motorway": 90.0, "trunk": 80.0, "primary": 60.0, "secondary": 45.0, "tertiary": 35.0, "unclassified": 30.0, "residential": 25.0, "service": 20.0, "track": 20.0, "path": 5.0}

#: Order of the five core components.
COMPONENTS = ("access", "pop", "veg", "ntl", "drought")


@dataclass(frozen=True)
class Params:
    iso_thresholds: tuple[float, ...] = (30.0, 60.0, 120.0, 240.0)
    weights: dict[str, float] = field(default_factory=lambda: {"access": 0.35, "pop": 0.25, "veg": 0.20, "ntl": 0.10, "drought": 0.10, "pov": 0.15, "food": 0.10, "mtt": 0.10, "rwi": 0.15})
    use_components: tuple[int, ...] = (1, 1, 0, 0, 1)
    mask_require_rural: bool = True
    mask_min_cropland: float = 0.05
    ntl_cap: float = 0.20
    veg_min: float = 0.40
    smooth_radius: int = 1
    smooth_preserve_nulls: bool = False
    top_pct_cells: float = 10.0
    top_km2: float | None = None
    min_cluster_cells: int = 30
    min_cluster_km2: float = 2.0
    prune_connectivity: int = 4
    cluster_connectivity: int = 8
    flood_depth_m: float = 0.3
    flood_exceed_fraction: float = 0.25
    road_classes: tuple[str, ...] = ()
    people_per_household: float = 5.0
    audit_radius_cells: int = 5
    radii_km: tuple[float, ...] = (5.0, 10.0, 30.0)
    od_alpha: float = 1.0
    od_gamma: float = 1.0
    od_impedance: str = "exp"
    od_lambda: float = 0.015
    od_beta: float = 1.5
    od_trips: float = 1_000_000.0
    od_cutoff_km: float | None = 1500.0
    od_ipf: bool = False
    od_agents: int = 50_000
    od_seed: int = 42
    rwi_weight: float = 0.25
    tilt_sign: int = 1
    road_speeds: dict[str, float] = field(default_factory=lambda: dict(ROAD_SPEEDS))
    off_road_kmh: float = 4.0
    extra_cost_min: float = 60.0
    mask_policy: str = "mask"
    min_aoi_overlap: float = 0.005

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


@dataclass(frozen=True)
class Scenario:
    """One row of a sweep: a name and the parameters that it changes."""

    scenario_id: str
    desc: str = ""
    changes: dict = field(default_factory=dict)

    def params(self, base: Params) -> Params:
        return base.with_(**self.changes)


def _weights(access: float, pop: float, veg: float, drought: float) -> dict[str, float]:
    return {"access": access, "pop": pop, "veg": veg, "ntl": 0.0, "drought": drought}


#: The sweep that is run when none is given. Its ids, descriptions, weights and limits.
SCENARIOS = (
    Scenario("baseline", "ACC+POP+DRT, rural-only, min crop 5%, 3x3 smooth, Top10%", {"weights": _weights(0.5, 0.3, 0.0, 0.2)}),
    Scenario("no_drought", "ACC+POP only; rural-only; min crop 5%; Top10%", {"use_components": (1, 1, 0, 0, 0), "weights": _weights(0.7, 0.3, 0.0, 0.0)}),
    Scenario("veg_signal", "ACC+POP+VEG; rural-only; min crop 10%; Top10%", {"use_components": (1, 1, 1, 0, 0), "weights": _weights(0.5, 0.3, 0.2, 0.0), "mask_min_cropland": 0.1}),
    Scenario("top_800km2", "ACC+POP+DRT, rural-only; select fixed 800 km²; mild smooth", {"weights": _weights(0.5, 0.3, 0.0, 0.2), "top_km2": 800.0}),
)


def sanitize_radii(radii) -> tuple[float, ...]:
    """Positive radii, each once, rising."""
    return tuple(sorted({float(r) for r in radii if r is not None and float(r) > 0}))
