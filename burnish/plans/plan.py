"""The plan: what to do to which column, as plain Python data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from burnish.plans.texts import from_texts

STEPS = ("drop", "duplicates", "types", "missing", "dates", "text", "outliers", "encode", "features", "scale", "validate")

# Words a plan may use for a strategy that the operators call otherwise.
SYNONYMS = {
    "encode": {
        "label_encode": "label", "onehot_encode": "onehot", "ordinal_encode": "ordinal",
        "target_encode": "target", "frequency_encode": "frequency",
    },
    "scale": {"log_transform": "log"},
    "duplicates": {"drop_keep_first": "keep_first", "drop_keep_last": "keep_last"},
    "dates": {"time_since": "days_since_earliest"},
}


@dataclass(frozen=True)
class Plan:
    """One field per kind of step, each ``{column: strategy}`` unless said otherwise."""

    summary: str = ""
    target: str | None = None
    drop: Sequence[str] = ()
    reasons: Mapping[str, str] = field(default_factory=dict)  # by dropped column, for the notes
    duplicates: str | None = None
    duplicate_key: str | Sequence[str] = "all"
    types: Mapping[str, str] = field(default_factory=dict)
    missing: Mapping[str, str] = field(default_factory=dict)
    dates: Mapping[str, str] = field(default_factory=dict)
    text: Mapping[str, str] = field(default_factory=dict)
    outliers: Mapping[str, str] = field(default_factory=dict)
    encode: Mapping[str, str] = field(default_factory=dict)
    features: Mapping[str, str] = field(default_factory=dict)
    scale: Mapping[str, str] = field(default_factory=dict)
    scale_exclude: Sequence[str] = ()
    checks: Mapping[str, object] = field(default_factory=dict)
    order: Sequence[str] = STEPS
    order_by: str | None = None
    stop_words: Sequence[str] | None = None

    @classmethod
    def from_dict(cls, config: Mapping[str, object]) -> Plan:
        """Read a plan, translating its words; a plan that scales or encodes its target raises before any job.

        Parts may be texts, ``"col:strategy,col:strategy"``, under their own names or those of a plan record: ``all:method``
        scales every numeric column, columns to drop may have a reason, ``col:reason``, and checks a value, ``min_rows:10``.
        """
        values = from_texts(config)
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown plan fields: {sorted(unknown)}")
        if values.get("target") in ("none", ""):
            values["target"] = None
        moved_drops, moved_features = [], {}
        for kind in ("encode", "scale", "dates"):
            values[kind] = {n: _translated(kind, s) for n, s in dict(values.get(kind, {})).items()}
        if values.get("duplicates"):
            values["duplicates"] = _translated("duplicates", values["duplicates"])
        for kind in ("missing", "encode", "text", "outliers"):
            kept = {}
            for name, strategy in dict(values.get(kind, {})).items():
                if strategy == "drop":
                    moved_drops.append(name)
                elif strategy in ("keep", "none"):
                    continue
                elif strategy == "length_feature":
                    moved_features[f"{name}_length"] = f"str_len:{name}"
                elif kind == "text" and strategy == "word_count":
                    moved_features[f"{name}_word_count"] = f"word_count:{name}"
                else:
                    kept[name] = strategy
            values[kind] = kept
        values["drop"] = [*values.get("drop", ()), *moved_drops]
        values["features"] = {**moved_features, **dict(values.get("features", {}))}
        plan = cls(**values)
        plan.check()
        return plan

    def check(self) -> None:
        wrong = [step for step in self.order if step not in STEPS]
        if wrong:
            raise ValueError(f"unknown steps in the order: {wrong}")
        if self.target:
            if self.target in self.scale:
                raise ValueError(f"the target is never scaled: {self.target}")
            if self.encode.get(self.target, "label") != "label":
                raise ValueError(f"the target may only be label encoded: {self.target}")


def _translated(kind: str, strategy: str) -> str:
    if kind == "dates":
        words = strategy.split(",") if isinstance(strategy, str) else strategy
        return ",".join(SYNONYMS[kind].get(w.strip(), w.strip()) for w in words)
    word, colon, arg = strategy.partition(":")
    return SYNONYMS[kind].get(word, word) + colon + arg
