"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

DAY_MICROS = 86_400_000_000

# The cell texts that a CSV reader treats as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The shape of a date text and the Spark pattern that reads it. A clock time and an offset from UTC are
# cut off before and added afterwards.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)
SLASHED = r"^(\d{1,2})[/-](\d{1,2})[/-]\d{4}$"
MONTH_FIRST, DAY_FIRST = "M/d/yyyy", "d/M/yyyy"
CLOCK_SHAPE = r"[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)? ?(Z|[+-]\d{2}:?\d{2})?$"

NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_SHAPE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def c(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, NUMERIC)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spell every missing float as NULL, so that one test finds all of them."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    if not floats:
        return df
    return df.withColumns({n: F.when(~F.isnan(c(n)), c(n)) for n in floats})


def round_safe(value: Column, places: int) -> Column:
    """Round without leaving a negative zero behind."""
    return F.when(F.abs(value) < 0.5 * 10**-places, F.lit(0.0)).otherwise(F.round(value, places))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to two places; NULL when there is nothing to share."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 2)


def log1p_floor(value: Column) -> Column:
    """log(1 + x) with negative x taken as zero; missing stays missing."""
    number = value.cast("double")
    return F.log1p(F.when(number < 0, F.lit(0.0)).otherwise(number))


def clip(value: Column, low: float, high: float) -> Column:
    number = value.cast("double")
    return F.when(number < low, F.lit(low)).when(number > high, F.lit(high)).otherwise(number)


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def parse_number(text: Column) -> Column:
    """Decimal text to double; anything else to NULL. Java suffixes such as ``1d`` are not numbers."""
    sign = F.when(F.ltrim(text).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double")).when(text.rlike(INFINITY_SHAPE), sign)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double, parsing it when it is text."""
    kind = type_of(df, name)
    if isinstance(kind, T.StringType):
        return parse_number(c(name))
    if isinstance(kind, (*NUMERIC, T.BooleanType)):
        return c(name).cast("double")
    return F.lit(None).cast("double")


def parse_flag(value: Column) -> Column:
    """Words for yes and no to boolean; unknown words to NULL."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin("true", "1", "yes", "1.0"), True).when(word.isin("false", "0", "no", "0.0"), False)


LONGEST_DATE = 50  # characters
# Bits of a mask of date shapes: one for each of DATE_SHAPES, then these.
CLOCK, EITHER, ONLY_MONTH_FIRST, ONLY_DAY_FIRST = (1 << len(DATE_SHAPES) + k for k in range(4))
SOME_DATE = ((1 << len(DATE_SHAPES)) - 1) | EITHER | ONLY_MONTH_FIRST | ONLY_DAY_FIRST
ANY_DATE = CLOCK | SOME_DATE


def _shape_bit(day: str) -> str:
    """SQL for the bit of the shape of a date without a clock time; 0 if it has none."""
    first, second = (f"try_cast(regexp_extract({day}, r'{SLASHED}', {k}) as int)" for k in (1, 2))
    tests = [f"when {day} rlike r'{pattern}' then {1 << k}" for k, (pattern, _) in enumerate(DATE_SHAPES)]
    return f"""case {" ".join(tests)}
        when not {day} rlike r'{SLASHED}' or least({first}, {second}) > 12 or greatest({first}, {second}) > 31 then 0
        when {first} > 12 then {ONLY_DAY_FIRST} when {second} > 12 then {ONLY_MONTH_FIRST} else {EITHER} end"""


def date_mask(name: str) -> Column:
    """Which shapes of a date the texts of a column have, as bits; 0 for none. The shape alone is looked at, not whether
    there is such a day.

    A date of two numbers and a year has one of three bits: the month must come first, the day must, or it may be either.
    """
    # Most texts end at one of the first tests: they are plain dates, hold no digit, or are no date. Within a function of
    # an array's elements a test is made only when those before it have failed; elsewhere Spark works out beforehand
    # what several branches share.
    text = "`" + name.replace("`", "``") + "`"
    timed = f"get(transform(array(regexp_replace(t, r'{CLOCK_SHAPE}', '')), d -> {_shape_bit('d')}), 0)"
    return F.expr(f"""coalesce(get(transform(array(trim({text})), t -> case
        when t is null then 0 when t rlike r'{DATE_SHAPES[0][0]}' then 1 when not t rlike r'[0-9]' or length(t) > {LONGEST_DATE} then 0
        when not t rlike r'{CLOCK_SHAPE}' then {_shape_bit('t')}
        else get(transform(array({timed}), b -> if(b > 0, b + {CLOCK}, 0)), 0) end), 0), 0)""")


def date_shapes(name: str) -> Column:
    """An aggregate: all shapes of dates that a text column holds, as bits."""
    return F.coalesce(F.bit_or(date_mask(name)), F.lit(0))


def day_comes_first(shapes: int) -> bool:
    """Whether 1/2/2023 is the first of February: some date can be read in no other way, and none only the other way."""
    return bool(shapes & ONLY_DAY_FIRST) and not shapes & ONLY_MONTH_FIRST


def parse_timestamp(text: Column, shapes: int = ANY_DATE) -> Column:
    """Text to timestamp without time zone. The shape is tested first, so that a bad text costs no exception.

    A date may be followed by hours and minutes, seconds, up to nine digits of a fraction (six are kept), and ``Z`` or
    an offset; a time with either is given in UTC. ``shapes`` tells which shapes the column holds, as ``date_shapes`` finds
    them; only these are tried. Where it does not settle which number is the month, 1/2/2023 is the second of January,
    and a date that can be read one way only is read that way.
    """
    text = F.trim(text)
    if not shapes & CLOCK:
        return _date(text, shapes)
    clock = text.rlike(CLOCK_SHAPE)
    day = F.when(clock, F.regexp_replace(text, CLOCK_SHAPE, "")).otherwise(text)
    date = _date(day, shapes)

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, CLOCK_SHAPE, group).try_cast("int"), F.lit(0))

    hour, minute, second = part(1), part(2), part(3)
    fraction = F.rpad(F.regexp_extract(text, CLOCK_SHAPE, 4), 6, "0").try_cast("long")
    micros = (hour.cast("long") * 3600 + minute * 60 + second) * 1_000_000 + F.coalesce(fraction, F.lit(0))
    offset = F.regexp_replace(F.regexp_extract(text, CLOCK_SHAPE, 5), "[Z:]", "")
    ahead = F.coalesce(F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int"), F.lit(0))
    micros = micros - F.when(offset.startswith("-"), -ahead).otherwise(ahead).cast("long") * 60_000_000
    moved = date + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    told = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(~clock, date).when(told, moved)


def _date(day: Column, shapes: int) -> Column:
    """A text without a clock time to the start of its day."""
    tries = []
    for k, (shape, fmt) in enumerate(DATE_SHAPES):
        if shapes >> k & 1:
            if fmt == "yyyy-M-d":
                read = day.try_cast("timestamp_ntz")
            else:
                # Month names in any case.
                read = F.try_to_timestamp(F.initcap(day) if "MMM" in fmt else day, F.lit(fmt)).cast("timestamp_ntz")
            tries.append(F.when(day.rlike(shape), read))
    if shapes & (EITHER | ONLY_MONTH_FIRST | ONLY_DAY_FIRST):
        slashed = F.regexp_replace(day, "-", "/")
        if day_comes_first(shapes):
            read = F.try_to_timestamp(slashed, F.lit(DAY_FIRST))
        elif shapes & ONLY_DAY_FIRST:
            turned = F.regexp_extract(day, SLASHED, 1).try_cast("int") > 12
            read = F.when(turned, F.try_to_timestamp(slashed, F.lit(DAY_FIRST))).otherwise(F.try_to_timestamp(slashed, F.lit(MONTH_FIRST)))
        else:
            read = F.try_to_timestamp(slashed, F.lit(MONTH_FIRST))
        tries.append(F.when(day.rlike(SLASHED), read.cast("timestamp_ntz")))
    return F.coalesce(*tries) if tries else F.lit(None).cast("timestamp_ntz")


def shapes_of(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """{column: aggregate of its date shapes}, for those of the columns that are text."""
    return {n: date_shapes(n) for n in names if isinstance(type_of(df, n), T.StringType)}


def as_timestamp(df: DataFrame, name: str, shapes: int = ANY_DATE) -> Column:
    kind = type_of(df, name)
    if isinstance(kind, T.StringType):
        return parse_timestamp(c(name), shapes)
    if isinstance(kind, TEMPORAL):
        return c(name).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def wall_micros(stamp: Column) -> Column:
    """Microseconds since 1970-01-01 on the wall clock, free of the session time zone."""
    seconds = F.hour(stamp).cast("long") * 3600 + F.minute(stamp) * 60
    micros = (F.extract(F.lit("SECOND"), stamp) * 1_000_000).cast("long")
    return F.unix_date(stamp.cast("date")).cast("long") * DAY_MICROS + seconds * 1_000_000 + micros


def yeo_johnson(value: Column, power: Column) -> Column:
    """Yeo-Johnson transform (Yeo and Johnson, 2000); its exponent may be a column too."""
    return F.when(value >= 0, _box_cox(value, power)).when(value < 0, -_box_cox(-value, 2 - power))


def _box_cox(value: Column, power: Column) -> Column:
    """((1 + value)^power - 1) / power, and its limit log(1 + value) at zero."""
    return F.when(F.abs(power) < 1e-12, F.log1p(value)).otherwise(F.try_divide(F.pow(value + 1, power) - 1, power))
