"""Analysis settings: defaults, validation, YAML/JSON loading and the dimension tables that queries join."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The default patterns, authors and weights that results depend on.
EXCLUDE_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "docs/swagger*", "docs/doc.go", "docs/openapi*", "*generated*",
    "mock_*", "*.gen.*",
)
ARCHITECTURE = (
    "*/repository/*interface*", "*/domainservice/", "*/router.go", "*/middleware/", "di/*.go", "*/core/", "*/stores/", "*/hooks/",
    "*/types/",
)
BLAME_EXTENSIONS = (
    "*.go", "*.ts", "*.tsx", "*.py", "*.rs", "*.java", "*.rb", "*.c", "*.h", "*.cpp", "*.hpp", "*.cc", "*.S", "*.scala", "*.hs", "*.ml",
    "*.mli",
)
CONVENTION_DIRS = ("services", "packages", "apps", "modules", "libs")
BOTS = ("github-actions[bot]", "renovate[bot]", "dependabot[bot]")
WEIGHTS = {
    "production": 0.15,
    "quality": 0.10,
    "survival": 0.25,
    "design": 0.20,
    "breadth": 0.10,
    "debt_cleanup": 0.15,
    "indispensability": 0.05,
}
UNITS = ("auto", "repo", "module")


@dataclass
class Config:
    tau: float = 180.0
    sample_size: int = 500
    debt_threshold: int = 10
    active_days: float = 30.0
    max_file_bytes: int = 5 * 1024 * 1024
    production_daily_ref: float = 1000.0
    untested_weight: float = 0.5
    min_substantial_lines: int = 1000
    critical: float = 0.80
    high: float = 0.60
    breadth_unit: str = "auto"
    breadth_min_commits: int = 3
    default_domains: bool = True
    blame_timeout: int = 120  # of runs that call the version-control tool; the readers here take its dumps
    convention_dirs: tuple[str, ...] = CONVENTION_DIRS
    exclude_files: tuple[str, ...] = EXCLUDE_FILES
    architecture: tuple[str, ...] = ARCHITECTURE
    blame_extensions: tuple[str, ...] = BLAME_EXTENSIONS
    exclude_authors: tuple[str, ...] = BOTS
    exclude_repos: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    domains: dict[str, dict] = field(default_factory=dict)  # name -> {"repos": [glob], "extensions": [ext]}
    teams: dict[str, dict] = field(default_factory=dict)  # name -> {"domain": str, "members": [author]}
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def __post_init__(self):
        total = sum(self.weights.values())
        if abs(total - 1) > 0.01:
            raise ValueError(f"weights must sum to 1, not {total:g}")
        if unknown := set(self.weights) - set(WEIGHTS):
            raise ValueError(f"unknown weights: {sorted(unknown)}")
        if self.breadth_unit not in UNITS:
            raise ValueError(f"breadth_unit must be one of {UNITS}")
        if self.tau <= 0 or self.production_daily_ref <= 0:
            raise ValueError("tau and production_daily_ref must be positive")
        if not 0 <= self.untested_weight <= 1:
            raise ValueError("untested_weight must lie in 0..1")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The dimension tables (each as small as the settings file itself)."""
        rows = {
            "aliases": ([(a, c) for a, c in sorted(self.aliases.items())], "alias string, canonical string"),
            "excluded_authors": ([(a,) for a in self.exclude_authors], "author string"),
            "excluded_repos": ([(r,) for r in self.exclude_repos], "repo string"),
            "domains": ([(d, p) for d, v in sorted(self.domains.items()) for p in v.get("repos", ())], "domain string, repo_pattern string"),
            "domain_extensions": ([(d, e) for d, v in sorted(self.domains.items()) for e in v.get("extensions", ())], "domain string, extension string"),
            "teams": ([(t, v.get("domain", ""), m) for t, v in sorted(self.teams.items()) for m in v.get("members", ()) or [None]], "team string, domain string, member string"),
        }
        return {k: spark.createDataFrame(r, s) for k, (r, s) in rows.items()}


def _domains(raw) -> dict[str, dict]:
    """Domains as {name: [globs]}, {name: {repos, extensions}} or a list of {name, repos, extensions}."""
    if isinstance(raw, list):
        return {d["name"]: {k: list(d.get(k) or ()) for k in ("repos", "extensions")} for d in raw}
    return {n: ({"repos": list(v)} if isinstance(v, list) else dict(v or {})) for n, v in (raw or {}).items()}


# Other names of settings in files; a dotted name stands for a value inside a group.
OTHER_NAMES = {
    "exclude_file_patterns": "exclude_files",
    "architecture_patterns": "architecture",
    "max_blame_file_bytes": "max_file_bytes",
    "untested_survival_weight": "untested_weight",
    "module_convention_dirs": "convention_dirs",
    "bus_factor.critical": "critical",
    "bus_factor.high": "high",
    "breadth.unit": "breadth_unit",
    "breadth.min_commits": "breadth_min_commits",
}


def _renamed(raw: dict) -> dict:
    """raw with the settings' own names; null settings keep their defaults."""
    flat = {}
    for name, value in raw.items():
        if name in ("bus_factor", "breadth"):
            flat |= {f"{name}.{k}": v for k, v in (value or {}).items()}
        else:
            flat[name] = value
    return {OTHER_NAMES.get(k, k): v for k, v in flat.items() if v is not None}


def load_config(path: str) -> Config:
    """Reads a JSON or (where a YAML parser is installed) YAML file; unknown settings are an error."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; JSON needs nothing") from e
        raw = yaml.safe_load(text) or {}
    raw = _renamed(raw)
    known = {f.name for f in fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "domains" in raw:
        raw["domains"] = _domains(raw["domains"])
    if "weights" in raw:
        raw["weights"] = WEIGHTS | raw["weights"]
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
