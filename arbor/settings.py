"""Settings of index and search, with their defaults, validation and precedence."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace

#: Fields of a node in the order in which their scores and positions are looked at.
FIELDS = ("title", "path_titles", "summary", "prefix_summary", "text")
#: The order in which phrases are looked for.
PHRASE_FIELDS = ("title", "summary", "prefix_summary", "path_titles", "text")

# Default weights and bonuses.
WEIGHTS = {"title": 5.0, "path_titles": 3.5, "summary": 3.0, "prefix_summary": 2.5, "text": 1.0}
BONUSES = {"exact_title": 5.0, "phrase": 3.0, "leaf": 1.0, "all_terms_hit": 2.0, "proximity": 1.5}
HEADING_PATTERNS = (
    r"^\d+\.\d+",
    r"^\d+\.\d+\.\d+",
    r"^[A-Z][A-Za-z\s\-/]{3,}$",
)


@dataclass(frozen=True)
class Settings:
    model: str = ""
    toc_check_page_num: int = 20
    max_page_num_each_node: int = 10
    max_token_num_each_node: int = 20_000
    index_include_text: bool = False
    query_default_top_k: int = 10
    query_expand_ancestors: int = 1
    query_leaf_only: bool = False
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    bonuses: dict = field(default_factory=lambda: dict(BONUSES))
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    proximity_window: int = 12
    diversity_penalty: float = 0.75
    debug_explain_default: bool = False
    recursive_split_enabled: bool = True
    recursive_split_min_pages: int = 4
    recursive_split_min_tokens: int = 2000
    recursive_split_max_depth: int = 3
    recursive_split_heading_patterns: tuple = HEADING_PATTERNS
    snippet_max_chars: int = 320
    snippet_context_chars: int = 120

    def __post_init__(self):
        if self.diversity_penalty < 0:
            raise ValueError("diversity_penalty must not be negative")
        for name, known in (("weights", WEIGHTS), ("bonuses", BONUSES)):
            unknown = set(getattr(self, name)) - set(known)
            if unknown:
                raise ValueError(f"unknown {name}: {sorted(unknown)}")
            object.__setattr__(self, name, {**known, **getattr(self, name)})

    def as_dict(self) -> dict:
        return asdict(self)


def load(user: dict | None = None, stored: dict | None = None) -> Settings:
    """Defaults, over them what a manifest stored, the environment's MODEL, then the user's values. Unknown keys fail."""
    known = {f.name for f in fields(Settings)}
    out = Settings()
    for source in (stored or {}, {"model": os.environ["MODEL"]} if os.environ.get("MODEL") else {}, user or {}):
        unknown = set(source) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = replace(out, **{k: v for k, v in source.items() if v is not None})
    return out


def read(path: str) -> dict:
    """Settings in a file: a JSON object, or YAML where that module is there. Null values count as not given."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no YAML module here; write the settings as JSON") from e
        values = yaml.safe_load(text) or {}
    else:
        values = json.loads(text)
    if not isinstance(values, dict):
        raise ValueError(f"{path}: settings are not an object")
    if "recursive_split_heading_patterns" in values:
        values["recursive_split_heading_patterns"] = tuple(values["recursive_split_heading_patterns"])
    return values


def yes(value: str | bool | None) -> bool:
    """Flags on the command line: only yes, in any case, is true."""
    return value if isinstance(value, bool) else str(value or "").lower() == "yes"
