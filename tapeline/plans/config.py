"""Configuration: defaults, named profiles, parameters, checks. All on the driver."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Collection
from dataclasses import dataclass
from pathlib import Path


# The shipped settings.
@dataclass(frozen=True)
class Config:
    """Settings of a tagging run. Taking marks away is off: measured, the surest of such merges are the worst."""

    backend: str = "faster-whisper"
    model: str = "large-v3-turbo"
    language: str | None = None
    word_level: bool = True
    sentence_level: bool = True
    sentence_gap: float = 5.0
    max_caption_words: int = 150
    cut_by_activity: bool = False
    condition_on_previous_text: bool = False  # to be switched together with cut_by_activity, or not at all
    carry_context: bool = False
    punctuate: bool = True
    demote_marks: bool = False
    window: int = 200
    stride: int = 150
    batch_size: int = 16
    mark_threshold: float = 0.9
    no_speech_max: float = 0.6
    logprob_min: float = -1.0
    compression_max: float = 2.4
    artifact_gap: float = 10.0
    artifact_words: int = 3
    artifact_count: int = 4


# The names of the decoding engines.
BACKENDS = ("openai", "faster-whisper")


def resolve(profiles: dict[str, dict], profile: str | None = None, params: dict | None = None, base: Config = Config(), models: Collection[str] | None = None) -> Config:
    """Defaults, then the profile, then the parameters; unknown names are errors. models: the names that there are weights for."""
    if profile is not None and profile not in profiles:
        raise ValueError(f"unknown profile {profile!r}; known: {sorted(profiles)}")
    given = {**(profiles[profile] if profile else {}), **(params or {})}
    known = {f.name for f in dataclasses.fields(Config)}
    if odd := set(given) - known:
        raise ValueError(f"unknown settings: {sorted(odd)}")
    return validated(dataclasses.replace(base, **given), models)


def validated(config: Config, models: Collection[str] | None = None) -> Config:
    if config.backend not in BACKENDS:
        raise ValueError(f"unknown backend {config.backend!r}; known: {list(BACKENDS)}")
    if models is not None and config.model not in models:
        raise ValueError(f"unknown model {config.model!r}; known: {sorted(models)}")
    if config.max_caption_words < 1:
        raise ValueError("max_caption_words must be positive")
    if not 0 < config.stride <= config.window:
        raise ValueError("windows must overlap or touch")
    return config


def overrides(specs: list[str]) -> dict:
    """FIELD=VALUE strings: values are JSON where they parse, else text."""
    known = {f.name for f in dataclasses.fields(Config)}
    out = {}
    for spec in specs:
        name, eq, value = spec.partition("=")
        if not eq or name not in known:
            raise ValueError(f"not a setting: {spec!r}")
        try:
            out[name] = json.loads(value)
        except json.JSONDecodeError:
            out[name] = value
    return out


def load_config(path: str | None = None) -> dict:
    """A JSON or (where a parser is installed) YAML file; CONFIG_PATH names one by default.

    Paths under `storage` may begin with ~, and are relative to the file's own folder; WEIGHTS_DIR takes the place of the weights'.
    """
    chosen = Path(path or os.environ.get("CONFIG_PATH", "profiles.json")).expanduser().absolute()
    if chosen.suffix in (".yml", ".yaml"):
        import yaml  # optional

        found = yaml.safe_load(chosen.read_text())
    else:
        found = json.loads(chosen.read_text())
    places = dict(found.get("storage") or {})
    if os.environ.get("WEIGHTS_DIR"):
        places["weights"] = os.environ["WEIGHTS_DIR"]
    if places:
        found["storage"] = {k: str(chosen.parent / Path(v).expanduser()) for k, v in places.items()}
    return found


def load_profiles(path: str | None = None) -> dict[str, dict]:
    """The profiles of such a file: its `runtime` part, or all of it where it has none."""
    found = load_config(path)
    return found.get("runtime", {k: v for k, v in found.items() if k != "storage"})
