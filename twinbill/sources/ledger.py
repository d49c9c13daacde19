"""Labelled ledgers: derived from order tables, or injected into a clean one.

All choices are key arithmetic, so the result is the same on every run, on any
number of partitions, and in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the resubmission types.
TYPES = ("exact", "format_shift", "amount_shift", "weak_resubmission")
#: One invoice in so many comes in again, the types by turns.
AGAIN = 6
#: One invoice in so many belongs to the vendor's standing order, or repeats the vendor's invoice before it.
STANDING = 5
#: Days from an invoice to its repeat: at least, and how many different ones.
REPEAT_AFTER, REPEAT_DAYS = 21, 37


def padded(number: Column, width: int) -> Column:
    """Zero-padded integer; longer numbers stay whole."""
    digits = number.cast("string")
    zeros = F.repeat(F.lit("0"), width - F.length(digits))
    # a format is read anew for every row, so only what needs its sign or has no value goes through it
    return F.when(number >= 0, F.concat(zeros, digits)).otherwise(F.format_string(f"%0{width}d", number))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_suppliers(lineitem: DataFrame) -> DataFrame:
    """Supplier and part of the first line of each order: the smallest (line, supplier, part)."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey")
    first = lineitem.groupBy("l_orderkey").agg(F.min(line).alias("line"))
    return first.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("line.l_suppkey").alias("sk"),
        F.col("line.l_partkey").alias("p_partkey"),
    )


def base_ledger(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One clean invoice per order that has lines."""
    ok, sk = F.col("o_orderkey"), F.col("sk")
    joined = orders.join(order_suppliers(lineitem), "o_orderkey").join(
        part.select("p_partkey", "p_name"), "p_partkey"
    )
    shared_bank = sk - sk % 6 + sk % 3
    return joined.select(
        ok.alias("key"),
        sk.alias("vendor_key"),
        F.concat(F.lit("F-"), padded(ok, 8)).alias("invoice_id"),
        F.concat(F.lit("G-"), padded(ok, 8)).alias("group_id"),
        F.concat(F.lit("SUP-"), padded(sk, 4)).alias("vendor_account_id"),
        F.concat(F.lit("INV-"), padded(sk, 4), F.lit("-"), padded(ok, 8)).alias("invoice_number"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.element_at(F.array(*[F.lit(c) for c in ("TRY", "EUR", "USD")]), (sk % 3 + 1).cast("int"))
        .alias("currency"),
        F.when(ok % 5 == 0, "")
        .otherwise(F.concat(F.lit("PO-"), padded(F.col("o_custkey") % 900, 5)))
        .alias("po_number"),
        F.concat(
            F.lit("BANK-"), padded(F.when(ok % 40 == 0, sk + 10000).otherwise(shared_bank), 4)
        ).alias("bank_fingerprint"),
        F.col("p_name").alias("description"),
    )


def with_resubmissions(base: DataFrame) -> DataFrame:
    """Every row, and for one in AGAIN of them a labelled copy some days later.

    ``base`` carries ``key`` (a non-negative long per row), ``vendor_key`` and
    ``cents`` beside the invoice columns. By type, a copy is the same paper
    again; the number typed with other separators, at times with a revision
    letter; the same number with a surcharge; or a bill under a number of its
    own, discounted, on the vendor's blanket order. Copies come out of the same
    pass over the rows as the originals.
    """
    number, cents, turn = F.col("invoice_number"), F.col("cents"), F.expr(f"key div {AGAIN * len(TYPES)}")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.expr(f"cast(key div {AGAIN} % {len(TYPES)} + 1 as int)"))
    separator = F.substring(F.lit("/._"), (turn % 3 + 1).cast("int"), F.lit(1))
    revision = F.when(F.expr(f"key div {AGAIN * len(TYPES) * 3} % 2 = 1"), "B").otherwise("")
    retyped = F.concat(F.replace(number, F.lit("-"), separator), revision)
    surcharge = F.expr(f"cents div (64 + key div {AGAIN * len(TYPES)} % 64)")
    discount = F.expr(f"cents div (34 + key div {AGAIN * len(TYPES)} % 30)")
    paper = {name: F.col(name) for name in base.columns} | {"duplicate_type": F.lit("original")}
    copy = paper | {
        "invoice_id": F.concat("invoice_id", F.lit("-2")),
        "invoice_date": F.date_add("invoice_date", (3 + turn % 17).cast("int")),
        "invoice_number": F.when(kind == "format_shift", retyped)
        .when(kind == "weak_resubmission", F.concat(F.lit("BILL "), F.reverse(padded(F.col("key"), 8))))
        .otherwise(number),
        "cents": F.when(kind == "amount_shift", cents + surcharge)
        .when(kind == "weak_resubmission", cents - discount)
        .otherwise(cents),
        "po_number": F.when(kind == "weak_resubmission", _vendor_order("PO-V", F.col("vendor_key"))).otherwise(
            F.col("po_number")
        ),
        "duplicate_type": kind,
    }
    once, again = (F.struct(*[value.alias(name) for name, value in row.items()]) for row in (paper, copy))
    return base.select(
        F.inline(F.when(F.col("key") % AGAIN == 1, F.array(once, again)).otherwise(F.array(once)))
    ).withColumn("is_duplicate_record", F.col("duplicate_type") != "original")


def _vendor_order(prefix: str, vendor: Column) -> Column:
    return F.concat(F.lit(prefix), padded(vendor, 4))


def with_standing_orders(base: DataFrame) -> DataFrame:
    """Legitimate repeats, in groups of their own: one invoice in STANDING bills its vendor's standing order.

    Such invoices of a vendor share amount, order number and description.
    """
    vendor, standing = F.col("vendor_key"), F.col("key") % STANDING == 2
    order = {
        "cents": (50_000 + 2_500 * (vendor % 40)).cast("bigint"),
        "description": F.lit("standing order"),
        "po_number": _vendor_order("PO-S", vendor),
    }
    return base.withColumns({name: F.when(standing, value).otherwise(F.col(name)) for name, value in order.items()})


def with_repeats(base: DataFrame) -> DataFrame:
    """Legitimate repeats, in groups of their own: one invoice in STANDING bills what its vendor's invoice before it
    billed, REPEAT_AFTER days later or more; two in three of them on the same order number.

    The invoice before is the last one by (date, id), undated ones last. It is looked up within the vendor's day
    first; across days only each day's last invoice is ranked, so no task sorts all rows of a large vendor.
    """
    day = ["vendor_account_id", "invoice_date"]
    billed = ["cents", "description", "po_number"]
    taken = F.struct("invoice_date", *billed)
    within_day = Window.partitionBy(*day).orderBy("invoice_id", *billed)
    across_days = Window.partitionBy(day[0]).orderBy(F.asc_nulls_last(day[1]))
    days = (
        base.groupBy(*day)
        .agg(F.max_by(taken, F.struct("invoice_id", *billed)).alias("last"))
        .select(*[F.col(c).alias(f"of_{c}") for c in day], F.lag("last").over(across_days).alias("carried"))
    )
    same_day = F.col("of_vendor_account_id").eqNullSafe(F.col(day[0])) & F.col("of_invoice_date").eqNullSafe(F.col(day[1]))
    seen = base.withColumn("same_day", F.lag(taken).over(within_day)).join(days, same_day)
    before, key = F.coalesce("same_day", "carried"), F.col("key")
    repeats = (key % STANDING == 2) & before["invoice_date"].isNotNull()
    after = F.date_add(before["invoice_date"], (REPEAT_AFTER + key % REPEAT_DAYS).cast("int"))
    changed = {
        "invoice_date": F.when(repeats, after).otherwise(F.col("invoice_date")),
        "cents": F.when(repeats, before["cents"]).otherwise(F.col("cents")),
        "description": F.when(repeats, before["description"]).otherwise(F.col("description")),
        "po_number": F.when(repeats & (key % (3 * STANDING) < 2 * STANDING), before["po_number"]).otherwise(
            F.col("po_number")
        ),
    }
    return seen.select(*[changed.get(c, F.col(c)).alias(c) for c in base.columns])


def inject(base: DataFrame, recurring: bool = False, standing: bool = False) -> DataFrame:
    """Clean rows plus labelled resubmissions, amounts back in currency units.

    ``recurring`` repeats invoices before, ``standing`` adds standing orders.
    """
    clean = with_standing_orders(base) if standing else base
    return (
        with_resubmissions(with_repeats(clean) if recurring else clean)
        .withColumn("amount", F.col("cents") / 100.0)
        .select(
            "invoice_id", "group_id", "vendor_account_id", "invoice_number", "invoice_date",
            "amount", "currency", "po_number", "bank_fingerprint", "description",
            "is_duplicate_record", "duplicate_type",
        )
    )


def keyed(invoices: DataFrame) -> DataFrame:
    """A clean invoice table in the form ``inject`` takes."""
    vendor_digits = F.regexp_replace("vendor_account_id", "[^0-9]", "")
    return invoices.select(
        "*",
        F.pmod(F.xxhash64("invoice_id"), F.lit(100_000_000)).alias("key"),
        F.coalesce(vendor_digits.try_cast("bigint"), F.lit(0)).alias("vendor_key"),
        F.round(F.col("amount") * 100).cast("bigint").alias("cents"),
    ).withColumn(
        "group_id",
        F.col("group_id") if "group_id" in invoices.columns else F.col("invoice_id"),
    ).drop("amount")


def labelled_ledger(
    spark: SparkSession, sf_dir: str, recurring: bool = False, standing: bool = False
) -> DataFrame:
    base = base_ledger(
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "lineitem"),
        read_table(spark, sf_dir, "part"),
    )
    return inject(base, recurring, standing)
