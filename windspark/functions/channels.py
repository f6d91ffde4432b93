"""Fixed channel names and groups."""

from __future__ import annotations

# Channel names of the simulator's logs, and what a study reads of them.
INPUTS = ["BldPitch1", "BldPitch2", "BldPitch3", "Azimuth", "RotSpeed", "NacYaw"]
OUTPUTS = ["RootFxb1", "RootMyb1", "TwrBsFxt", "TwrBsMyt", "TTDspFA", "GenPwr"]
TASKS = {"root": ["RootFxb1", "RootMyb1"], "tower": ["TwrBsFxt", "TwrBsMyt"], "dsp": ["TTDspFA"], "pwr": ["GenPwr"]}
DERIVED = ["BldPitch1", "BldPitch2", "BldPitch3", "RotSpeed"]
# Output order of data sets that carry no names.
UNNAMED_OUTPUTS = [
    "TTDspFA", "TTDspSS", "TTDspTwst", "RotTorq", "LSSGagMya", "LSSGagMza",
    "YawBrFxp", "YawBrFyp", "YawBrFzp", "YawBrMxp", "YawBrMyp", "YawBrMzp",
    "TwrBsFxt", "TwrBsFyt", "TwrBsFzt", "TwrBsMxt", "TwrBsMyt", "TwrBsMzt",
    "RootFxb1", "RootFyb1", "RootFzb1", "RootMxb1", "RootMyb1", "RootMzb1",
    "TipDxb1", "TipDyb1", "TipDzb1", "GenPwr", "GenTq",
]
# Older names of two features.
FEATURE_ALIASES = {
    "hub_mean_u": "hub_u_mean", "hub_mean_U": "hub_u_mean", "hub_u": "hub_u_mean", "hubU_mean": "hub_u_mean",
    "global_mean_u": "global_u_mean", "global_mean_U": "global_u_mean",
}


def resolve_alias(key: str, names: list[str]) -> str:
    """Present name of a feature; an unknown one is an error."""
    found = FEATURE_ALIASES.get(key, key)
    if found not in names:
        raise KeyError(f"no feature {key!r} (read as {found!r})")
    return found


def split_tasks(names: list[str], groups: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Task groups with the outputs that exist; empty groups go."""
    kept = {k: [x for x in v if x in names] for k, v in (groups or TASKS).items()}
    return {k: v for k, v in kept.items() if v}
