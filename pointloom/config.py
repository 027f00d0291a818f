"""Typed parameters of the point-cloud stages."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Defaults of all stages; `from_mapping` overrides them by name."""

    voxel: float = 0.03
    ground_threshold: float = 0.08
    ransac_rounds: int = 100
    blind_radius: float = 0.35
    blind_radius_online: float = 0.45
    veto_distance: float = 0.05
    ground_thickness: float = 0.05
    ground_margin: float = 0.03
    shell_margin: float = 0.15
    shell_thin_margin: float = 0.04
    near_wall_share: float = 0.6
    max_height: float = 0.55
    azimuth_bins: int = 360
    elevation_bins: int = 90
    range_angle_deg: float = 10.0
    dbscan_eps: float = 0.25
    dbscan_min_points: int = 12
    default_intensity: float = 100.0
    min_cluster: int = 12
    volumetricity_min: float = 0.03
    v_nominal: float = 0.005
    gamma: float = 10.0
    rho_base: float = 80.0
    rho_floor: float = 10.0
    n0: float = 30.0
    kappa_n: float = 5.0
    kappa_volume: float = 1.5
    dihedral_share: float = 0.88
    dihedral_low_deg: float = 55.0
    dihedral_high_deg: float = 125.0
    body_extents: tuple[float, float, float] = (0.35, 0.35, 0.42)
    circle_low: float = 0.14
    circle_high: float = 0.22
    circle_rms: float = 0.025
    arc_rescue: bool = False
    score_threshold: float = 2.0
    sigma_field: float = 0.012
    sigma_gradient: float = 0.05
    huber: float = 0.03
    field_default: float = 0.08
    bandwidth: float = 0.06
    bandwidth_min: float = 0.015
    yaw_starts: int = 8
    yaw_kept: int = 2
    newton_rounds: int = 4
    gate: float = 9.21  # the 97.3 % quantile of chi-square with 3 degrees of freedom
    nis_limit: float = 7.814727903251179  # its 95 % quantile
    timeout_s: float = 2.0
    init_health: float = 20.0
    buffer_window: int = 5
    buffer_trigger: int = 30
    buffer_cap: int = 300
    buffer_voxel: float = 0.02

    @classmethod
    def from_mapping(cls, values: dict) -> Config:
        """Values by field name, flat or in sections; unknown names raise."""
        flat: dict = {}
        for k, v in values.items():
            flat |= v if isinstance(v, dict) else {k: v}
        unknown = set(flat) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items()})

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """Values from a YAML document."""
        import yaml

        return cls.from_mapping(yaml.safe_load(text) or {})


DEFAULT = Config()
