"""Settings: defaults, a YAML file over them, and the data folder from an argument or TESSELITE_DATA_DIR."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    data_dir: str = "~/.tesselite"
    embedding_model: str = "hash"
    bit_width: int = 4
    default_limit: int = 8
    low_confidence: float = 0.3
    auto_index: bool = False
    auto_retain_turns: bool = True
    retain_every_n_turns: int = 1
    retain_max_chars: int = 1200
    recall_max_chars: int = 4000


def load(data_dir: str | None = None) -> Config:
    """The settings of a data folder; unknown names and values of another type in its config.yaml are errors."""
    at = data_dir or os.environ.get("TESSELITE_DATA_DIR") or Config.data_dir
    path = Path(at).expanduser() / "config.yaml"
    own: dict = {}
    if path.is_file():
        import yaml

        own = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    kinds = {f.name: type(f.default) for f in fields(Config)}
    for name, value in own.items():
        if name not in kinds:
            raise ValueError(f"unknown setting {name!r}")
        own[name] = float(value) if kinds[name] is float else value
        if not isinstance(own[name], kinds[name]):
            raise ValueError(f"{name} must be {kinds[name].__name__}")
    own["retain_every_n_turns"] = max(1, own.get("retain_every_n_turns", 1))
    return Config(**{**own, "data_dir": at})


def save(config: Config) -> None:
    """Write every setting but the folder itself into the folder's config.yaml."""
    import yaml

    folder = Path(config.data_dir).expanduser()
    folder.mkdir(parents=True, exist_ok=True)
    values = {k: v for k, v in asdict(config).items() if k != "data_dir"}
    (folder / "config.yaml").write_text(yaml.safe_dump(values), encoding="utf-8")
