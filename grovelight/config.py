"""Run settings, from YAML of either dialect or from Python."""

from __future__ import annotations

from dataclasses import dataclass, fields

MODES = ("classification", "regression")


@dataclass(frozen=True)
class RunConfig:
    train: str = "train.csv"
    test: str = "test.csv"
    pred_out: str = "pred.csv"
    test_out: str = "y_true.csv"
    sep: str = ","
    label: str = "target"
    split_mode: str = "file"
    split_dir: str = "."
    mode: str = "classification"
    n_bins: int = 10
    n_estimators: int = 100
    criterion: str = "gini"
    max_depth: int = 10
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str | float | int = "sqrt"
    bootstrap: bool = True
    max_samples: float | int | None = None
    random_state: int = 0
    quantile: tuple[int, ...] = ()
    oob: bool = False
    use_weighted_classes: bool = False
    #: How the compatible readings of ambiguous formulas are chosen.
    oob_denominator: str = "all"
    weighted_gini: str = "lengths"
    compat_min_reduction: bool = False
    max_classes: int = 1000
    #: Rows are numbered by the draw of their "values", or as "lines" of the files, so that predictions stand in file order.
    row_ids: str = "values"
    #: "draws" deals a sample of exact size; "poisson" lets each row draw its own copies, without a shuffle.
    bootstrap_method: str = "draws"
    #: Shared folder for manifests of growth, from which a run that was cut off goes on.
    run_folder: str | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.split_mode not in ("file", "directory"):
            raise ValueError("split mode must be 'file' or 'directory'")
        if self.max_depth < 1 or self.n_bins < 1 or self.n_estimators < 1:
            raise ValueError("max_depth, n_bins and n_estimators must be at least 1")
        if any(q < 0 for q in self.quantile):
            raise ValueError("quantile indices must not be negative")
        if self.mode == "regression" and self.use_weighted_classes:
            raise ValueError("class weights can't be used in regression")
        if self.mode == "regression" and self.oob:
            object.__setattr__(self, "oob", False)
        if self.oob_denominator not in ("all", "oob") or self.weighted_gini not in ("lengths", "weights"):
            raise ValueError("unknown formula")
        if self.row_ids not in ("values", "lines"):
            raise ValueError("row_ids must be 'values' or 'lines'")
        if self.bootstrap_method not in ("draws", "poisson"):
            raise ValueError("bootstrap_method must be 'draws' or 'poisson'")
        if self.bootstrap_method == "poisson" and not (self.bootstrap and (self.max_samples is None or isinstance(self.max_samples, float))):
            raise ValueError("'poisson' samples with replacement, and by a share of the rows")


def parse_quantile(text) -> tuple[int, ...]:
    """'' -> (), '3' -> (3,), '0,1' -> (0, 1); a number stands for itself."""
    if text is None or text == "":
        return ()
    if isinstance(text, int):
        return (text,)
    if isinstance(text, (list, tuple)):
        return tuple(int(x) for x in text)
    return tuple(int(x) for x in str(text).split(",") if x.strip())


def _flat(section) -> dict:
    """A mapping, or a list of one-key mappings, as one mapping."""
    if isinstance(section, list):
        return {k: v for part in section for k, v in part.items()}
    return dict(section or {})


def read_config(path: str) -> RunConfig:
    """Settings from a YAML file; ``.yaml`` is tried where ``.yml`` is missing. The first top-level section is used."""
    import os

    import yaml

    if not os.path.exists(path) and path.endswith(".yml"):
        path = path[:-4] + ".yaml"
    with open(path, encoding="utf-8") as f:
        top = next(iter(yaml.safe_load(f).values()))
    places = {"input": {"train": "train", "test": "test"}, "output": {"pred": "pred_out", "test": "test_out"}, "format": {"sep": "sep", "label": "label", "label_col": "label"}, "split": {"mode": "split_mode", "dir": "split_dir"}}
    found: dict = {}
    for section, names in places.items():
        for key, value in _flat(top.get(section)).items():
            if key in names:
                found[names[key]] = value
    if "mode" not in top or "n_bins" not in top:
        raise ValueError("mode and n_bins are mandatory")
    own = {f.name for f in fields(RunConfig)}
    found |= {k: v for k, v in top.items() if k in own and k not in places and v is not None}
    found["quantile"] = parse_quantile(top.get("quantile"))
    return RunConfig(**found)
