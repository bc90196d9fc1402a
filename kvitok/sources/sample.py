"""Billing views over the sample tables.

Accounts are customers, addresses their nation and segment, months the months of
orders, and charge lines the line items. Mail is written from line items too, one
message each, so it needs no grouping. Nothing here hints a broadcast: Spark picks
the join from the sizes of the tables it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.functions.numbers import MONEY, QUANTITY

# Names as bills print them.
RAW_SERVICES = (
    "ХВС КПУ",
    "ХВС пр.д.",
    "ГВС КПУ",
    "ГВС пр. д.",
    "Водоотв.",
    "Отопление",
    "Сод.жил.",
    "кап. ремонт",
    "ТКО",
    "Запирающее устр.",
    "Обсл. шлагбаумов",
    "Домофон",
)

# The order in which lines arrived; all columns together leave no ties that matter.
ARRIVAL = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "quantity",
    "amount_due",
    "l_shipdate",
)

SENDER = "bills@billing.example"
RECIPIENT = "household@home.example"
SUBJECT = "Единый платежный документ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(text: Column, width: int) -> Column:
    """Zeros up to a width; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def _account(column: str) -> Column:
    return padded(F.col(column).cast("string"), 10)


def raw_service(key: Column) -> Column:
    names = F.array(*[F.lit(n) for n in RAW_SERVICES])
    return F.get(names, F.pmod(key, F.lit(len(RAW_SERVICES))).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills without lines: account and month of each order."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _account("o_custkey").alias("account_number"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        "o_orderdate",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_totalprice").cast(MONEY).alias("total_price"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account and address of every customer."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        _account("c_custkey").alias("account_number"),
        F.concat("n_name", F.lit(", "), "c_mktsegment").alias("address"),
    )


def billed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that ever got a bill, as the accounts table would hold them."""
    billed = orders(spark, sf_dir).select("account_number").distinct()
    return addresses(spark, sf_dir).join(billed, "account_number", "left_semi")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).join(addresses(spark, sf_dir), "account_number")


def charge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as charge lines with their arrival columns."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select(*columns, "l_shipdate")
    heads = orders(spark, sf_dir).select("o_orderkey", "account_number", "year", "month")
    return items.join(heads, items.l_orderkey == heads.o_orderkey).select(
        "account_number",
        "year",
        "month",
        raw_service(F.col("l_partkey")).alias("raw_service"),
        F.col("l_quantity").cast(QUANTITY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("amount_due"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw service names that the parts on sale give."""
    return table(spark, sf_dir, "part").select(raw_service(F.col("p_partkey")).alias("raw_service")).distinct()


def analysis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses stored so far: urgent, closed orders were analysed on arrival."""
    done = bills(spark, sf_dir).where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return done.select(
        "address",
        "year",
        "month",
        F.concat(F.lit("Счёт "), "account_number").alias("prompt"),
        F.concat(
            F.lit("### Итог\n**"),
            "account_number",
            F.lit("** & *"),
            "o_orderpriority",
            F.lit("*\n- сумма "),
            F.col("total_price").cast("string"),
        ).alias("response"),
        F.concat(F.lit("model-"), "o_orderstatus").alias("model"),
        F.floor("total_price").cast("int").alias("tokens_used"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("seq"),
    )


def bill_texts(spark: SparkSession, sf_dir: str, moving: bool = False) -> DataFrame:
    """A plain-text bill with two service lines for each line item.

    The line number decides the defects and the return flag which apartment facts
    are printed, so that all branches of the parser see many bills. With ``moving``
    the bills of an account name different flats of its address. Items are dealt by their
    keys, as their files may be too few to read them in parallel.
    """
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    columns += ("l_returnflag", "l_linestatus", "l_shipdate")
    items = table(spark, sf_dir, "lineitem").select(*columns)
    heads = bills(spark, sf_dir).select("o_orderkey", "account_number", "address", "year", "month")
    if moving:
        flat = (F.col("o_orderkey") % 3).cast("string")
        heads = heads.withColumn("address", F.concat("address", F.lit(", кв. "), flat))
    money = F.col("l_extendedprice").cast(MONEY).cast("string")
    quantity = F.col("l_quantity").cast(QUANTITY).cast("string")
    first, second = raw_service(F.col("l_partkey")), raw_service(F.col("l_suppkey"))
    area = F.concat((F.lit(30) + F.col("l_partkey") % 60).cast("string"), F.lit(".5"))
    living = F.concat((F.lit(10) + F.col("l_suppkey") % 20).cast("string"), F.lit(".2"))
    rooms = (F.lit(1) + F.col("l_partkey") % 4).cast("string")
    residents = (F.lit(1) + F.col("l_suppkey") % 5).cast("string")
    paid = F.date_format("l_shipdate", "dd.MM.yyyy")
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    account = F.when(number == 6, F.lit("")).otherwise(
        F.when(number == 5, F.concat(F.lit("код плательщика: "), "account_number")).otherwise(
            F.concat(F.lit("ФЛС № "), "account_number")
        )
    )
    month = F.when((number == 7) & (flag == "A"), F.lit(13)).otherwise(F.col("month"))
    period = F.when(
        number == 2,
        F.concat(
            F.lit(" на "), F.col("year").cast("string"), F.lit("-"),
            F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("-01"),
        ),
    ).otherwise(
        F.concat(
            F.lit(" ПЕРИОД: "), month.cast("string"), F.lit(" месяц "), F.col("year").cast("string"),
            F.lit(" год"),
        )
    )
    total = F.when((number == 7) & (flag == "N"), F.concat(money, F.lit(".7"))).otherwise(
        F.replace(money, F.lit("."), F.lit(","))
    )
    apartment = F.when(
        flag == "A",
        F.concat(
            F.lit("\nТип кв.: отдельная, К-во комнат: "), rooms, F.lit(" Площадь общая: "), area,
            F.lit(", жилая: "), living, F.when((number == 3), F.lit(".")).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit(""))
    people = F.when(
        flag != "R", F.concat(F.lit("\nК-во проживающих: "), residents)
    ).otherwise(F.lit(""))
    payment = F.when(flag == "A", F.concat(F.lit("\nДата последней оплаты: "), paid)).otherwise(F.lit(""))
    head = F.concat(account, F.lit(" АДРЕС: "), "address", period)
    lines = F.array(
        F.struct(first.alias("raw"), quantity.alias("quantity"), money.alias("amount")),
        F.struct(
            second.alias("raw"),
            F.concat(number.cast("string"), F.lit(",250")).alias("quantity"),
            F.col("l_quantity").cast(MONEY).cast("string").alias("amount"),
        ),
    )
    tail = F.concat(F.lit("Итого к оплате: "), total, apartment, people, payment)
    body = F.concat(
        head,
        F.lit("\n"),
        F.array_join(
            F.transform("lines", lambda x: F.concat(x["raw"], F.lit(" "), x["quantity"], F.lit(" "), x["amount"])),
            "\n",
        ),
        F.lit("\n"),
        F.col("tail"),
    )
    pad = lambda c, n: padded(F.col(c).cast("string"), n)
    msg_id = F.concat_ws(
        "-",
        pad("l_orderkey", 12),
        pad("l_linenumber", 2),
        pad("l_partkey", 12),
        pad("l_suppkey", 12),
        padded(quantity, 12),
        padded(money, 16),
    )
    # Texts are written behind the deal, so only narrow rows travel; a fixed number of partitions keeps
    # Spark from joining them by their size alone, which says little about the work that follows.
    dealt = items.join(heads, items.l_orderkey == heads.o_orderkey).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return (
        dealt.select("*", msg_id.alias("msg_id"), head.alias("head"), lines.alias("lines"), tail.alias("tail"))
        .select(
            "msg_id",
            F.col("l_shipdate").cast("timestamp").alias("received_at"),
            F.col("l_linenumber").alias("kind"),
            F.col("l_linestatus").alias("status"),
            "head",
            "lines",
            "tail",
            body.alias("body"),
        )
    )
