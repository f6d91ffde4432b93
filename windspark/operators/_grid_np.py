"""NumPy formulas of the 45 snapshot features, for a batch of grids (helper inside tasks).

Arrays are (n, a, b): axis 1 is i, axis 2 is j. Standard deviations are of samples
(n - 1) unless weighted.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-8
REGIONS = ["hub", "yaw", "tip", "corr", "top", "bottom", "left", "right"]

# Names and order of the columns.
FEATURES = [
    "global_u_mean", "global_v_mean", "global_w_mean", "global_u_std", "global_v_std", "global_w_std",
    "global_tke", "global_speed_max", "global_gust_factor", "global_grad_norm",
    "hub_u_mean", "hub_tke", "yaw_u_mean", "yaw_u_std", "tip_u_mean", "tip_speed_range",
    "corr_u_mean", "corr_tke", "corr_ti_u", "corr_flow_inclination", "corr_flow_direction",
    "vertical_shear_u", "vertical_shear_w", "vertical_shear_norm",
    "lateral_asymmetry_u", "lateral_asymmetry_v", "lateral_tke_diff", "lateral_asymmetry_speed",
    "global_ti_total", "global_anisotropy_ratio", "global_reynolds_stress", "hub_ti_total",
    "tip_vorticity_strength", "corr_turbulence_ratio",
    "global_curvature_mean", "global_laplacian_norm", "spatial_heterogeneity", "vertical_gradient_ratio", "lateral_gradient_ratio",
    "global_skewness_u", "global_kurtosis_u", "extreme_wind_ratio",
    "kinetic_energy_density", "shear_production_rate", "energy_cascade_indicator",
]


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """Zero-padded size x size neighbourhoods of every point: (n, a, b, size * size)."""
    r = size // 2
    padded = np.pad(x, ((0, 0), (r, r), (r, r)))
    seen = np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(1, 2))
    return seen.reshape(*x.shape, size * size)


def grid_features(u: np.ndarray, v: np.ndarray, w: np.ndarray, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    mean = lambda x: x.mean((1, 2))
    std = lambda x: x.reshape(len(x), -1).std(1, ddof=1)
    slope = lambda x, axis: mean(np.abs(np.diff(x, axis=axis)))
    at = lambda x, r: np.tensordot(x, weights[r], 2)
    spread = lambda x, r: np.einsum("nij,ij->n", (x - at(x, r)[:, None, None]) ** 2, weights[r])
    energy = lambda r: 0.5 * (spread(u, r) + spread(v, r) + spread(w, r))
    speed = np.sqrt(u * u + v * v + w * w + TINY)
    stds = [std(x) for x in (u, v, w)]
    variance = sum(s * s for s in stds)
    s_mean, s_max = mean(speed), speed.max((1, 2))
    on_tip = weights["tip"] > 0
    tip = speed * on_tip
    tip_low = np.where(tip > 0, tip, 1e9).min((1, 2))
    corr = {c: at(x, "corr") for c, x in (("u", u), ("v", v), ("w", w))}
    shear_u = at(u, "top") - at(u, "bottom")
    fluct_u = u - mean(u)[:, None, None]
    reynolds = mean(fluct_u * (v - mean(v)[:, None, None]))
    bend_u, bend_v = np.diff(u, 2, axis=1), np.diff(v, 2, axis=1)
    rise = np.abs(np.diff(u, axis=2, prepend=u[:, :, :1]))
    z = fluct_u / (u.std((1, 2)) + TINY)[:, None, None]
    q05, q95 = np.quantile(speed.reshape(len(u), -1), [0.05, 0.95], axis=1)
    smooth = sum(std(windows(x, 5).mean(3)) ** 2 for x in (u, v, w))
    corr_tke, hub_u = energy("corr"), at(u, "hub")
    lateral_u = at(u, "left") - at(u, "right")
    return {
        "global_u_mean": mean(u), "global_v_mean": mean(v), "global_w_mean": mean(w),
        "global_u_std": stds[0], "global_v_std": stds[1], "global_w_std": stds[2],
        "global_tke": 0.5 * variance, "global_speed_max": s_max, "global_gust_factor": s_max / (s_mean + TINY),
        "global_grad_norm": np.hypot(slope(speed, 1), slope(speed, 2)),
        "hub_u_mean": hub_u, "hub_tke": energy("hub"), "yaw_u_mean": at(u, "yaw"), "yaw_u_std": np.sqrt(spread(u, "yaw")),
        "tip_u_mean": at(u, "tip"), "tip_speed_range": tip.max((1, 2)) - tip_low,
        "corr_u_mean": corr["u"], "corr_tke": corr_tke, "corr_ti_u": np.sqrt(spread(u, "corr")) / (corr["u"] + TINY),
        "corr_flow_inclination": np.arctan2(corr["w"], corr["u"]), "corr_flow_direction": np.arctan2(corr["v"], corr["u"]),
        "vertical_shear_u": shear_u, "vertical_shear_w": at(w, "top") - at(w, "bottom"), "vertical_shear_norm": shear_u / (corr["u"] + TINY),
        "lateral_asymmetry_u": lateral_u, "lateral_asymmetry_v": at(v, "left") - at(v, "right"),
        "lateral_tke_diff": energy("left") - energy("right"), "lateral_asymmetry_speed": at(speed, "left") - at(speed, "right"),
        "global_ti_total": np.sqrt(variance) / (s_mean + TINY), "global_anisotropy_ratio": np.max(stds, 0) / (np.min(stds, 0) + TINY),
        "global_reynolds_stress": reynolds, "hub_ti_total": np.sqrt(2 * energy("hub")) / (hub_u + TINY),
        "tip_vorticity_strength": np.hypot(slope(tip, 1), slope(tip, 2)),
        "corr_turbulence_ratio": corr_tke / (0.5 * sum(c * c for c in corr.values()) + TINY),
        "global_curvature_mean": mean(np.sqrt(bend_u**2 + bend_v**2 + TINY)),
        "global_laplacian_norm": mean(np.abs(bend_u[:, :, 1:-1] + np.diff(u, 2, axis=2)[:, 1:-1])),
        "spatial_heterogeneity": std(windows(speed, 3).var(3, ddof=1)),
        "vertical_gradient_ratio": (at(rise, "top") + TINY) / (at(rise, "bottom") + TINY),
        "lateral_gradient_ratio": np.abs(lateral_u) / (mean(u) + TINY),
        "global_skewness_u": mean(z**3), "global_kurtosis_u": mean(z**4) - 3,
        "extreme_wind_ratio": q95 / (q05 + TINY),
        "kinetic_energy_density": mean(0.5 * (u * u + v * v + w * w)),
        "shear_production_rate": slope(u, 1) * np.abs(reynolds),
        "energy_cascade_indicator": 0.5 * smooth / (0.5 * variance + TINY),
    }


def resize_matrix(n_from: int, n_to: int) -> np.ndarray:
    """Bilinear weights (n_to, n_from) with half-pixel centres and clamped edges."""
    x = np.maximum((np.arange(n_to) + 0.5) * n_from / n_to - 0.5, 0)
    low = np.minimum(x.astype(int), n_from - 1)
    high = np.minimum(low + 1, n_from - 1)
    part = x - low
    out = np.zeros((n_to, n_from))
    np.add.at(out, (np.arange(n_to), low), 1 - part)
    np.add.at(out, (np.arange(n_to), high), part)
    return out
