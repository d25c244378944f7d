"""Plans whose parts are texts, such as ``"price:fill_median,city:fill_mode"``."""

from __future__ import annotations

from collections.abc import Mapping

# The names that the parts of a plan have as a record of texts, and what they are here.
RECORD_FIELDS = {
    "plan_summary": "summary", "target_column": "target", "columns_to_drop": "drop", "missing_value_strategy": "missing",
    "encoding_strategy": "encode", "scaling_strategy": "scale", "outlier_strategy": "outliers",
    "feature_engineering": "features", "text_processing": "text", "datetime_processing": "dates",
    "duplicate_strategy": "duplicates", "final_validation_checks": "checks", "step_by_step_order": "order",
}

#: Words by which a step may be called in an order, beside its own name.
STEP_WORDS = {
    "drop": ("columns",), "duplicates": ("duplicate", "dedupe", "deduplicate"), "types": ("type", "dtype", "dtypes"),
    "missing": ("nulls", "null"), "dates": ("datetime", "datetimes", "date"), "text": ("texts",),
    "outliers": ("outlier",), "encode": ("encoding", "categorical"), "features": ("feature", "engineering"),
    "scale": ("scaling", "normalize"), "validate": ("validation", "checks"),
}
DEFAULT_TERMS = 50  # of tfidf and countvec where no number is given
NOTHING = ("", "none", "n/a")


def entries(text: str) -> dict[str, str]:
    """``"a:x,b:y,z"`` as {"a": "x", "b": "y,z"}.

    A name ends at the first colon of its part. A part without a colon goes on with the strategy before it, as in
    ``size:ordinal:S,M,L``; before any colon it is a name without a strategy.
    """
    out: dict[str, str] = {}
    last = None
    for part in text.split(","):
        name, colon, strategy = part.partition(":")
        if colon:
            last = name.strip()
            out[last] = strategy.strip()
        elif last is not None:
            out[last] += "," + part.rstrip()
        elif part.strip():
            out[part.strip()] = ""
    return out


def step_order(text: str) -> list[str]:
    """Steps in the order in which a text names them, each once; a name that tells no step, or two, is an error."""
    out = []
    for name in filter(None, (x.strip().lower() for x in text.split(","))):
        words = name.replace("-", "_").replace(" ", "_").split("_")
        known = [step for step, others in STEP_WORDS.items() if step in words or step == name]
        known = known or [step for step, others in STEP_WORDS.items() if set(others) & set(words)]
        if len(known) > 1 and known[0] == "drop":
            known = known[1:]  # as in drop_duplicates
        if len(known) != 1:
            raise ValueError(f"a step of the order is not known: {name}")
        if known[0] not in out:
            out.append(known[0])
    return out


def _scalar(text: str) -> object:
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return float(text)
    except ValueError:
        return text


def from_texts(config: Mapping[str, object]) -> dict[str, object]:
    """A plan's parts as the structures that a plan has; parts that are none already are left as they are."""
    out: dict[str, object] = {}
    for name, value in config.items():
        kind = RECORD_FIELDS.get(name, name)
        if kind in out:
            raise ValueError(f"a plan names {kind} twice")
        empty = isinstance(value, str) and value.strip().lower() in NOTHING
        if not isinstance(value, str) or kind in ("summary", "duplicate_key", "order_by"):
            out[kind] = value
        elif kind in ("target", "duplicates"):
            out[kind] = None if empty else value.strip()
        elif kind == "order":
            if not empty:
                out[kind] = step_order(value)
        elif kind == "drop":
            reasons = {} if empty else entries(value)
            out["drop"] = list(reasons)
            out["reasons"] = {n: why for n, why in reasons.items() if why}
        elif kind == "checks":
            out[kind] = {} if empty else {n: _scalar(v) if v else True for n, v in entries(value).items()}
        elif kind in ("scale_exclude", "stop_words"):
            out[kind] = [x.strip() for x in value.split(",") if x.strip()]
        else:
            out[kind] = {} if empty else entries(value)
    if "all" in out.get("scale", {}):
        out["scale"] = {"__all_numeric__" if n == "all" else n: how for n, how in out["scale"].items()}
    text = out.get("text", {})
    out["text"] = {n: f"{how}:{DEFAULT_TERMS}" if how in ("tfidf", "countvec") else how for n, how in text.items()}
    return out
