"""Detector profiles: which error rates a simulation may use, and whether its results may be reported."""

from __future__ import annotations

import json
import os

#: Rates a simulation needs, how far a profile and the model it names may differ, the default profile.
RATES = ("false_negative_rate", "false_positive_rate", "timing_jitter_std_s")
TOLERANCE = 1e-9
DEFAULT = "dnn_event_v3"


class CalibrationError(RuntimeError):
    """A profile that does not support what it is asked for."""


def _number(v) -> float | None:
    return None if v is None or isinstance(v, str) and v.strip().upper() == "TODO" else float(v)


def active_profile(name: str | None = None, env: str | None = None, active_document: str | None = None) -> str:
    """The name given, else that of the environment variable ``env``, else that in the active document, else the default."""
    return name or (os.environ.get(env, "").strip() if env else "") or (json.loads(active_document).get("active_profile") if active_document else None) or DEFAULT


def simulation_rates(profile: dict, model: dict, event_level_only: bool = True) -> dict[str, float]:
    """The rates of an observation model, once they are known to be complete, at event level and the profile's own."""
    name, rates = profile.get("profile"), {k: _number(model.get(k)) for k in RATES}
    missing = [k for k, v in rates.items() if v is None]
    if missing:
        raise CalibrationError(f"profile {name!r} is not calibrated: {', '.join(missing)} missing")
    if event_level_only and not profile.get("evaluation", {}).get("event_level", False):
        raise CalibrationError(f"profile {name!r} was scored by frames; rates per passage need event-level scores")
    for k, v in rates.items():
        declared = _number(profile.get("simulation", {}).get(k))
        if declared is None:
            raise CalibrationError(f"profile {name!r} declares no {k}")
        if abs(declared - v) > TOLERANCE:
            raise CalibrationError(f"profile {name!r} declares {k} = {declared}, the model applies {v}")
    return rates


def assert_reportable(profile: dict) -> None:
    """Final, at event level, with a measured jitter; else all that is wrong at once."""
    simulation = profile.get("simulation", {})
    wrong = []
    if profile.get("status", "preliminary") != "final":
        wrong.append("not final")
    if not profile.get("evaluation", {}).get("event_level", False):
        wrong.append("not at event level")
    if not str(simulation.get("timing_jitter_provenance", "")).startswith("measured"):
        wrong.append("jitter not measured")
    if wrong:
        raise CalibrationError(f"profile {profile.get('profile')!r} is not reportable: {', '.join(wrong)}")
