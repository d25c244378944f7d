"""Categorical encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.columns import c
from burnish.operators.ordered import order_keys
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run
from burnish.operators.values import (
    ROWS,
    VALUE,
    Categories,
    CategoryNeed,
    grouped_values,
    local_frame,
    looked_up,
    number_sorted,
)

METHODS = ("label", "onehot", "sparse", "frequency", "binary", "ordinal", "target")
CODE = "__code"
WIDEST = 10_000  # values that onehot makes a column for each of


def encode(df: DataFrame, encodings: Mapping[str, str], order_by: str | Sequence[str] | None = None) -> Outcome:
    """Encode columns by label, onehot, sparse, frequency, ordinal:<v1,v2,...>, binary or target:<column>.

    Label, sparse, frequency and target take their codes from a distributed table with one row per value, however many there
    are; it is in ``mappings`` of the outcome. ``onehot`` makes a column for each value but the first, for at most ``WIDEST``
    values; ``sparse`` puts the same ones and zeros into one sparse vector column, ``<column>_onehot``, for any number of
    values, and ``onehot_long`` gives them as rows. ``binary`` needs ``order_by``: the value seen second becomes 1.
    """
    late: list[Note] = []
    mappings: dict[str, DataFrame] = {}
    steps, notes = encode_steps(df, df.columns, encodings, order_by, late, mappings)
    out = run(df, steps)
    return Outcome(out, tuple([*notes, *late]), mappings)


def encode_steps(
    df: DataFrame,
    names: Sequence[str],
    encodings: Mapping[str, str],
    order_by: str | Sequence[str] | None = None,
    late: list[Note] | None = None,
    mappings: dict[str, DataFrame] | None = None,
) -> tuple[list[Step], list[Note]]:
    late = late if late is not None else []
    mappings = mappings if mappings is not None else {}
    steps, notes = [], []
    for name, method in encodings.items():
        word, _, arg = method.partition(":")
        if word in ("none", "keep"):
            continue
        if word not in METHODS:
            raise ValueError(f"unknown encoding for {name}: {method}")
        if name not in names:
            notes.append(Note("encode", name, "skipped", "column not found"))
        elif word == "target" and arg not in names:
            notes.append(Note("encode", name, "skipped", f"target column '{arg}' not found"))
        elif word == "binary" and not order_by:
            raise ValueError(f"binary encoding of {name} needs order_by: which value comes first depends on it")
        elif word in ("onehot", "binary"):
            steps.append(_fitted_step(name, word, order_by, late, mappings))
        elif word == "sparse":
            steps.append(_sparse_step(name, late, mappings))
        else:
            steps.append(_looked_up_step(name, word, arg, late, mappings))
    return steps, notes


def _looked_up_step(name: str, word: str, arg: str, late: list[Note], mappings: dict[str, DataFrame]) -> Step:
    reads = frozenset({name, arg} if word == "target" else {name})

    def transform(df: DataFrame, found: Found) -> DataFrame:
        if word in ("label", "ordinal"):
            df = df.withColumn(name, c(name).cast("string"))
        table = dictionary(df, name, word, arg)
        mappings[name] = table.select(F.col(VALUE).cast("string").alias("value"), F.col(CODE).cast("double").alias("code"))
        late.append(Note("encode", name, "done", word))
        return looked_up(df, name, table, CODE)

    # Codes may be written while the step is applied, so it has to see what earlier steps have changed.
    return Step(fit_reads=reads, reads=reads, writes=frozenset({name}), needs=lambda df: Needs(), transform=transform)


def _sparse_step(name: str, late: list[Note], mappings: dict[str, DataFrame]) -> Step:
    one, made = frozenset({name}), f"{name}_onehot"

    def transform(df: DataFrame, found: Found) -> DataFrame:
        table = number_sorted(grouped_values(df, name, {}), VALUE, CODE)
        size = max(0, table.count() - 1)  # all that the driver learns of the values
        mappings[name] = table.where(F.col(CODE) > 0).select(
            F.col(VALUE).cast("string").alias("value"), (F.col(CODE) - 1).cast("double").alias("code")
        )
        late.append(Note("encode", name, "done", f"sparse: {made} of size {size}"))
        if not size:
            return df.drop(name)
        # The smallest value and missing ones have the place that the encoder leaves out.
        place = F.when(F.col(name_of_place) > 0, F.col(name_of_place) - 1).otherwise(size).cast("double")
        placed = looked_up(df.withColumn(name_of_place, c(name)), name_of_place, table, CODE).withColumn(name_of_place, place)
        encoder = OneHotEncoder(inputCols=[name_of_place], outputCols=[made], dropLast=True)
        model = encoder.fit(local_frame(df.sparkSession, [(float(size),)], f"{name_of_place} double"))
        return model.transform(placed).drop(c(name), name_of_place)

    name_of_place = f"__place_{made}".replace("`", "_").replace(".", "_")
    return Step(fit_reads=one, reads=one, writes=frozenset({name, made}), needs=lambda df: Needs(), transform=transform, opens_columns=True)


def dictionary(df: DataFrame, name: str, word: str, arg: str = "") -> DataFrame:
    """(value, code) of a column: one row per value that is not missing."""
    if word == "ordinal":
        codes = [(value.strip(), i) for i, value in enumerate(arg.split(","))]
        return local_frame(df.sparkSession, list(dict(codes).items()), f"{VALUE} string, {CODE} long")
    if word == "target":
        return grouped_values(df, name, {CODE: F.mean(c(arg).cast("double"))})
    table = grouped_values(df, name, {})
    if word == "label":
        return number_sorted(table, VALUE, CODE)
    total = table.agg(F.sum(ROWS).alias("__total"))  # one row
    return table.crossJoin(F.broadcast(total)).withColumn(CODE, F.col(ROWS) / F.col("__total"))


def _need(name: str, word: str, order_by: str | Sequence[str] | None) -> CategoryNeed:
    if word == "binary":
        return CategoryNeed(name, {"__first": F.min(F.struct(*[c(n) for n in order_keys(order_by)]))}, 2)
    return CategoryNeed(name, limit=WIDEST)


def _fitted_step(
    name: str, word: str, order_by: str | Sequence[str] | None, late: list[Note], mappings: dict[str, DataFrame]
) -> Step:
    reads = frozenset({name, *(order_keys(order_by) if word == "binary" else [])})
    need = _need(name, word, order_by)

    def transform(df: DataFrame, found: Found) -> DataFrame:
        act = _onehot if word == "onehot" else _binary
        return act(df, name, found.categories[need.key], late, mappings)

    return Step(
        fit_reads=reads,
        reads=reads,
        writes=frozenset({name}),
        needs=lambda df: Needs(categories=(need,)),
        transform=transform,
        opens_columns=word == "onehot",
    )


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _onehot(df: DataFrame, name: str, categories: Categories, late: list[Note], mappings: dict) -> DataFrame:
    if categories.too_many:
        raise ValueError(f"{name} has more than {WIDEST} values, too many for a column each; use sparse instead of onehot")
    values = sorted(r[VALUE] for r in categories.rows)[1:]
    columns = {f"{name}_{_text(v)}": F.coalesce((c(name) == F.lit(v)).cast("int"), F.lit(0)) for v in values}
    late.append(Note("encode", name, "done", f"onehot: {', '.join(columns)}"))
    return df.withColumns(columns).drop(name) if columns else df.drop(name)


def onehot_long(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """The ones of a one-hot encoding as rows: the key columns and the name of the column that would hold the 1.

    As in the wide form, the smallest value, and missing ones, have no column. This works for any number of values.
    """
    first = grouped_values(df, name, {}).agg(F.min(VALUE).alias("__first"))  # one row
    rows = df.select(*[c(n) for n in keys], c(name).alias("__cell")).crossJoin(F.broadcast(first))
    column = F.concat(F.lit(f"{name}_"), F.col("__cell").cast("string")).alias("column")
    return rows.where(F.col("__cell") > F.col("__first")).select(*[c(n) for n in keys], column)


def _binary(df: DataFrame, name: str, categories: Categories, late: list[Note], mappings: dict) -> DataFrame:
    if categories.too_many or len(categories.rows) != 2:
        count = "more than 2" if categories.too_many else len(categories.rows)
        late.append(Note("encode", name, "skipped", f"not binary: {count} values"))
        return df
    zero, one = sorted(categories.rows, key=lambda r: tuple(r["__first"]))
    late.append(Note("encode", name, "done", "binary"))
    coded = [(_text(zero[VALUE]), 0.0), (_text(one[VALUE]), 1.0)]
    mappings[name] = local_frame(df.sparkSession, coded, "value string, code double")
    return df.withColumn(name, F.coalesce((c(name) == F.lit(one[VALUE])).cast("int"), F.lit(0)))


def encoding_report(spark: SparkSession, outcome: Outcome) -> DataFrame:
    """(column, status, detail, value, code): a row for each value of an encoded column, whole at any number of values;
    for a column without codes, one row that tells its new columns or why it was skipped."""
    notes = [n for n in outcome.notes if n.step == "encode"]
    plain = [(n.column, n.status, n.detail) for n in notes if n.status != "done" or n.column not in outcome.mappings]
    out = local_frame(spark, plain, "column string, status string, detail string")
    out = out.withColumns({"value": F.lit(None).cast("string"), "code": F.lit(None).cast("double")})
    for n in notes:
        if n.status == "done" and n.column in outcome.mappings:
            told = {"column": F.lit(n.column), "status": F.lit(n.status), "detail": F.lit(n.detail)}
            out = out.unionByName(outcome.mappings[n.column].withColumns(told))
    return out
