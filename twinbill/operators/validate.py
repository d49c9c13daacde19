"""Checks on an invoice table, as one aggregate or as codes per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from twinbill.functions.text import strip_whitespace
from twinbill.schema import INVOICE_COLUMNS, LABEL_COLUMNS, STRICT_AMOUNT
from twinbill.session import materialize

# Length limits, amount ceiling and currency form of the contract.
ID_LENGTH = 80
PO_LENGTH = 80
DESCRIPTION_LENGTH = 500
MAX_AMOUNT = 1_000_000_000
CURRENCY_FORM = r"\A[A-Z]{3}\z"
CONTROL_CHARACTER = r"[\x00-\x1f]"
DECIMAL_FORM = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
EXPONENT_FORM = r"[eE]"
THIRD_DECIMAL = r"\.\d{2}\d*[1-9]"
DATE_FORM = r"\A\d{4}-\d{2}-\d{2}\z"
_HOUR, _MINUTE = r"([01]\d|2[0-3])", r"[0-5]\d"
TIMESTAMP_FORM = (
    rf"\A\d{{4}}-\d{{2}}-\d{{2}}([T ]{_HOUR}:{_MINUTE}(:{_MINUTE}(\.\d+)?)?(Z|[+-]{_HOUR}:?{_MINUTE})?)?\z"
)

_ID = "id"
_IDENTIFIERS = ("invoice_id", "vendor_account_id", "invoice_number", "bank_fingerprint")
_NO_CONTROL = ("invoice_id", "vendor_account_id", "bank_fingerprint")


def missing_columns(df: DataFrame, labels: bool) -> list[str]:
    wanted = set(INVOICE_COLUMNS) | ({"group_id"} if labels else set())
    return sorted(wanted - set(df.columns))


def unknown_columns(df: DataFrame, allowed: tuple[str, ...] = INVOICE_COLUMNS) -> list[str]:
    return sorted(set(df.columns) - set(allowed))


def require_columns(df: DataFrame, labels: bool) -> None:
    missing = missing_columns(df, labels)
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def forbid_unknown_columns(df: DataFrame, allowed: tuple[str, ...] = INVOICE_COLUMNS) -> None:
    extra = unknown_columns(df, allowed)
    if extra:
        raise ValueError(f"unknown columns: {extra}")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Invoice ids that occur more than once."""
    return df.groupBy("invoice_id").agg(F.count("*").alias("copies")).filter("copies > 1")


def as_date(value: Column, form: str = TIMESTAMP_FORM) -> Column:
    """ISO date, by default with an ISO time after it; NULL where the text is none.

    The whole text must name a day, and where it has a time one that exists; the
    time is left out then.
    """
    text = value.cast("string")
    return F.when(text.rlike(form), F.left(text, F.lit(10)).try_cast("date"))


def _faults(labels: bool) -> dict[str, Column]:
    """The table rules that a row breaks by itself; the first one needs more than the row."""
    required = [*INVOICE_COLUMNS, *(["group_id"] if labels else [])]
    amount = F.col("amount").try_cast("double")
    any_null = F.lit(False)
    for name in required:
        any_null = any_null | F.col(name).isNull()
    not_a_number = F.col("amount").isNotNull() & (
        amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf"))
    )
    return {
        "bad_amounts": F.coalesce((amount <= 0) | not_a_number, F.lit(False)),
        "rows_with_null": any_null,
        "bad_dates": as_date(F.col("invoice_date")).isNull(),
    }


def check_profile(df: DataFrame, labels: bool) -> DataFrame:
    """One row with what the table-level rules need, without a shuffle of rows."""
    checks = {name: F.count_if(fault) for name, fault in _faults(labels).items()}
    return df.agg(F.count("*").alias("rows"), *[c.alias(name) for name, c in checks.items()])


@dataclass(frozen=True)
class Census:
    """What one scan tells of an invoice table: the profile of the table rules, the ids that occur more than
    once, and the blocks with more rows than asked for."""

    profile: Row
    repeated: DataFrame
    crowded: DataFrame


def take_census(df: DataFrame, labels: bool, blocks: dict[str, str] | None = None, rows: int = 0) -> Census:
    """Profile, repeated ids and crowded blocks in one pass over ``df``.

    A row sends a 64-bit hash of its id and its faults, and the value of each
    block it belongs to; both are summed on the map side first. What occurs
    once (or in up to ``rows`` rows) is folded into one row for each kind, so only hashes that
    occur twice and large blocks come out. An id is looked at as text only if
    its hash occurs twice, which rules out false alarms.
    """
    faults = {name: fault.cast("int") for name, fault in _faults(labels).items()}
    text = F.lit(None).cast("string")

    def entry(kind: str, digest: Column, value: Column, currency: Column, counted: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("block"),
            digest.alias("digest"),
            value.alias("block_value"),
            currency.alias("currency"),
            *[(fault if counted else F.lit(0)).alias(name) for name, fault in faults.items()],
        )

    entries = [entry(_ID, F.xxhash64("invoice_id"), text, text, True)]
    for name, column in (blocks or {}).items():
        value, currency = F.col(column).cast("string"), F.col("currency").cast("string")
        entries.append(entry(name, F.lit(None).cast("bigint"), value, currency, False))
    keys = ["block", "digest", "block_value", "currency"]
    counted = (
        df.select(F.inline(F.array(*entries)))
        .groupBy(*keys)
        .agg(F.count("*").alias("rows"), *[F.sum(name).alias(name) for name in faults])
    )
    stands_out = F.when(F.col("block") == _ID, F.col("rows") > 1).otherwise(F.col("rows") > rows)
    folded = [F.when(F.col("stands_out"), F.col(k)).alias(k) for k in keys[1:]]
    found = materialize(
        counted.withColumn("stands_out", stands_out)
        .groupBy("block", "stands_out", *folded)
        .agg(*[F.sum(name).alias(name) for name in ("rows", *faults)]),
        "census",
    )
    ids = found.where(F.col("block") == _ID)
    profile = ids.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("rows", *faults)]).first()
    twice = ids.where("stands_out").select("digest")
    suspects = df.select("invoice_id", F.xxhash64("invoice_id").alias("digest")).join(twice, "digest", "left_semi")
    crowded = found.where((F.col("block") != _ID) & F.col("stands_out"))
    return Census(
        profile,
        # nothing to look for, nothing read
        duplicate_ids(suspects) if not twice.isEmpty() else duplicate_ids(twice.select(text.alias("invoice_id"))),
        crowded.select("block", "block_value", "currency"),
    )


def raise_broken(census: Census) -> None:
    """Raise on the first broken table rule, in the documented order."""
    seen = census.profile
    if seen["rows"] == 0:
        raise ValueError("the invoice table is empty")
    if not census.repeated.isEmpty():
        raise ValueError("every invoice_id has to be unique")
    if seen["bad_amounts"] > 0:
        raise ValueError("amounts have to be positive numbers")
    if seen["rows_with_null"] > 0:
        raise ValueError("a required field is null")
    if seen["bad_dates"] > 0:
        raise ValueError("invoice dates have to be ISO dates")


def validate(df: DataFrame, labels: bool = False) -> None:
    """Raise on the first broken rule, in the documented order."""
    require_columns(df, labels)
    raise_broken(take_census(df, labels))


def typed(df: DataFrame, strict: bool = False) -> DataFrame:
    """Validated text columns as dates and numbers.

    The strict contract holds amounts as two-place decimals before the
    double arithmetic; the file path has no such rule.
    """
    amount = F.col("amount").try_cast(STRICT_AMOUNT) if strict else F.col("amount")
    return df.withColumns(
        {"invoice_date": as_date(F.col("invoice_date")), "amount": amount.try_cast("double")}
    )


def trimmed_ids(df: DataFrame) -> DataFrame:
    """Surrounding white space of the four identifiers removed."""
    return df.withColumns({c: strip_whitespace(F.col(c)) for c in _IDENTIFIERS})


def _codes() -> list[Column]:
    def when(broken: Column, code: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(code))

    codes = [
        when(~F.length(F.col(c)).between(1, ID_LENGTH), f"{c}_length") for c in _IDENTIFIERS
    ]
    codes += [
        when(F.col(c).rlike(CONTROL_CHARACTER), f"{c}_control_character") for c in _NO_CONTROL
    ]
    text = strip_whitespace(F.col("amount").cast("string"))
    exact = text.try_cast("decimal(38,18)")
    codes += [
        when(as_date(F.col("invoice_date"), DATE_FORM).isNull(), "invoice_date_invalid"),
        when(~text.rlike(DECIMAL_FORM), "amount_not_a_number"),
        # a number too long for the decimal type is NULL here
        F.when(exact <= 0, "amount_not_positive"),
        F.when(
            (exact > MAX_AMOUNT) | (exact.isNull() & text.rlike(DECIMAL_FORM)), "amount_too_large"
        ),
        # without an exponent the text itself tells, however many digits it has
        F.when(
            F.when(text.rlike(EXPONENT_FORM), exact != F.round(exact, 2)).otherwise(
                text.rlike(DECIMAL_FORM) & text.rlike(THIRD_DECIMAL)
            ),
            "amount_decimals",
        ),
        when(~F.col("currency").rlike(CURRENCY_FORM), "currency_form"),
        when(F.length("po_number") > PO_LENGTH, "po_number_length"),
        when(F.length("description") > DESCRIPTION_LENGTH, "description_length"),
    ]
    return codes


def with_violations(df: DataFrame) -> DataFrame:
    """Strict row contract: adds ``violations``, the codes each row breaks.

    Identifiers are judged and kept without surrounding white space; a missing
    PO number or description counts as empty.
    """
    filled = trimmed_ids(df).withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("po_number", "description")}
    )
    codes = _codes()
    if "unknown_fields" in filled.columns:
        codes.append(F.when(F.size("unknown_fields") > 0, "unknown_field"))
    return filled.withColumn(
        "violations", F.filter(F.array(*codes), lambda code: code.isNotNull())
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


def null_cells(df: DataFrame) -> Column:
    """Number of NULL cells over all columns, as an aggregate."""
    total = F.lit(0)
    for name in df.columns:
        total = total + F.col(name).isNull().cast("int")
    return F.coalesce(F.sum(total), F.lit(0))


def quality_profile(df: DataFrame) -> DataFrame:
    """Scalar profile of a labelled ledger, one row."""
    return profile_and_groups(df).drop("groups")


def profile_and_groups(df: DataFrame) -> DataFrame:
    """``quality_profile`` and the number of groups.

    Ids and groups are reduced to one row each before they are counted, so
    only (id, partial sums) and (group, size) travel, in one pass each.
    """
    scalars = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("invoice_id").alias("unique_invoice_ids"),
        null_cells(df).alias("null_cells"),
        F.count_if(F.col("amount") <= 0).alias("non_positive_amounts"),
        F.min("invoice_date").alias("date_min"),
        F.max("invoice_date").alias("date_max"),
    )
    groups = group_sizes(df).agg(
        F.count_if(F.col("records") > 1).alias("duplicate_groups"), F.count("*").alias("groups")
    )
    parts = scalars.unionByName(groups, True)
    names = [
        "rows", "unique_invoice_ids", "null_cells", "non_positive_amounts",
        "date_min", "date_max", "duplicate_groups", "groups",
    ]
    return parts.agg(*[F.max(name).alias(name) for name in names])


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("group_id").agg(F.count("*").alias("records"))


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in LABEL_COLUMNS if c in df.columns]
