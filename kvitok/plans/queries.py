"""Every query by name. Each takes a session and a folder of sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvitok.functions import numbers, text
from kvitok.functions.names import normalize_service
from kvitok.functions.tariff import analysis_tariff
from kvitok.operators import aggregates, analysis, chart, checks, history, messages, parse, upsert
from kvitok.session import shared_dir
from kvitok.sources import mail, mime, sample
from kvitok.sources.sample_mail import sample_mail
from kvitok.streaming.ingest import queue as open_queue
from kvitok.streaming.ingest import start_ingest
from kvitok.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The chart range and the length of the work queue that the queries use.
CHART_START, CHART_END = (1995, 3), (2001, 6)
QUEUE_LIMIT = 50

TRIAGE = (sample.SENDER, sample.RECIPIENT, sample.SUBJECT)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _charges(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.upsert_charges(sample.charge_lines(spark, sf), sample.ARRIVAL)


def _located(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.at_addresses(_charges(spark, sf), sample.addresses(spark, sf))


def _months(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.month_services(_located(spark, sf))


def _charged(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct address-months with charges. Upserting lines first would not change them."""
    lines = sample.charge_lines(spark, sf).select("account_number", "year", "month")
    per_account = aggregates.charged_periods(lines, ("account_number",))
    return aggregates.charged_periods(
        aggregates.at_addresses(per_account, sample.addresses(spark, sf)), ("address",)
    )


def _services(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.service_rows(sample.catalogue(spark, sf))


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.period_rows(sample.orders(spark, sf))


def _breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.month_breakdown(_months(spark, sf), _services(spark, sf))


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.upsert_analyses(sample.analysis_log(spark, sf), ("created_at", "seq"))


def _chart(spark: SparkSession, sf: str) -> DataFrame:
    return chart.chart_long(_located(spark, sf), _periods(spark, sf), CHART_START, CHART_END)


def _bill_text(spark: SparkSession, sf: str) -> DataFrame:
    return sample.bill_texts(spark, sf).select("msg_id", "received_at", "body")


def _messages(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    return mime.read_messages(sample_mail(spark, sf), fields=fields)


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return mail.accept(mime.read_messages(sample_mail(spark, sf), rule=TRIAGE, bills=True), TRIAGE)


def _double(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


# Dimensions and upserts


@query
def accounts_dim(spark: SparkSession, sf: str) -> DataFrame:
    rows = upsert.account_rows(sample.bills(spark, sf), ("o_orderkey",))
    return rows.select("account_number", "address")


@query
def periods_dim(spark: SparkSession, sf: str) -> DataFrame:
    return _periods(spark, sf).select("year", "month", F.col("start_date").cast("string"))


@query
def services_dim(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.service_rows(sample.charge_lines(spark, sf)).select("name", "unit")


@query
def service_name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    lines = sample.charge_lines(spark, sf).groupBy("raw_service").agg(F.count(F.lit(1)).alias("n"))
    return lines.select("raw_service", normalize_service(F.col("raw_service")).alias("name"), "n")


@query
def charges_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _charges(spark, sf).select(
        "account_number", "year", "month", "service", *_double("quantity", "amount_due", "accrued_by_tariff")
    )


@query
def period_info_upsert(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse.parse_texts(_bill_text(spark, sf)).drop("body")
    stored = parsed.where(
        "defect IS NULL AND account_number IS NOT NULL AND year <> 0 AND month BETWEEN 1 AND 12"
    )
    return upsert.upsert_period_info(stored, ("received_at", "msg_id")).drop("meter_readings")


@query
def raw_imports_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows per account: every stored bill counts, also a repeated one."""
    bills = parse.stored_bills(parse.parse_messages(_accepted(spark, sf)))
    rows = upsert.import_rows(bills, F.current_timestamp())
    return rows.groupBy("source_type", "account_number").agg(
        F.count(F.lit(1)).alias("n"), F.max("source_identifier").alias("last_source")
    )


@query
def constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    accounts, periods = sample.addresses(spark, sf), _periods(spark, sf)
    services = _services(spark, sf)
    per_account = checks.key_counts(accounts, ["account_number", "address"])
    per_period = checks.key_counts(periods, ["year", "month"])
    lines = checks.key_counts(upsert.charge_rows(sample.charge_lines(spark, sf)), upsert.CHARGE_KEY)
    log = sample.analysis_log(spark, sf)
    texts = ("prompt", "response", "model")
    flags = [F.col(c).isNotNull().alias(c) for c in texts]
    runs = checks.key_counts(log.select(*analysis.ANALYSIS_KEY, *flags), [*analysis.ANALYSIS_KEY, *texts])
    month_ok = F.col("month").between(1, 12)
    return checks.all_checks(
        [
            checks.row_checks(
                per_account,
                {
                    "accounts.account_number not null": F.col("account_number").isNotNull(),
                    "accounts.address not null": F.col("address").isNotNull(),
                },
            ),
            checks.row_checks(per_period, {"periods.month range": month_ok}),
            checks.row_checks(
                lines,
                {
                    "charges.account not null": F.col("account_number").isNotNull(),
                    "charges.service not null": F.col("service").isNotNull(),
                    "charges.month range": month_ok,
                },
            ),
            checks.row_checks(runs, {f"analysis.{c} not null": F.col(c) for c in texts}),
            checks.unique_check(checks.key_counts(accounts, ["account_number"]), "accounts unique"),
            checks.unique_check(per_period, "periods unique"),
            checks.unique_check(checks.key_counts(services, ["name"]), "services unique"),
            checks.unique_check(lines, "charge lines unique"),
            checks.unique_check(checks.key_counts(log, analysis.ANALYSIS_KEY), "analysis log unique"),
            checks.reference_check(lines, accounts, "charges.account exists", ["account_number"]),
            checks.reference_check(lines, periods, "charges.period exists", ["year", "month"]),
            checks.reference_check(
                lines.withColumnRenamed("service", "name"), services, "charges.service exists", ["name"]
            ),
            checks.reference_check(runs, periods, "analysis.period exists", ["year", "month"]),
        ]
    )


def _checked(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables after their upserts."""
    parsed = parse.parse_texts(_bill_text(spark, sf)).drop("body").where(
        "defect IS NULL AND account_number IS NOT NULL AND year <> 0 AND month BETWEEN 1 AND 12"
    )
    # Two tables hold them, so they are parsed once and stored.
    path = shared_dir(spark, "bills")
    parsed.write.parquet(path)
    bills = spark.read.schema(parsed.schema).parquet(path)
    return {
        "accounts": sample.addresses(spark, sf),
        "periods": _periods(spark, sf),
        "services": _services(spark, sf),
        "charges": _charges(spark, sf),
        "account_period_info": upsert.upsert_period_info(bills, ("received_at", "msg_id")),
        "raw_imports": upsert.import_rows(bills, F.current_timestamp()),
        "address_analysis": _analyses(spark, sf),
    }


@query
def table_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of every constraint in the tables as they are stored."""
    return checks.table_checks({name: checks.table_counts(name, rows) for name, rows in _checked(spark, sf).items()})


def planted_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Tables that break every constraint: repeated and missing keys, absent parents, NULLs and a month 13."""
    orders, lines = sample.orders(spark, sf), upsert.charge_rows(sample.charge_lines(spark, sf))
    homes = sample.addresses(spark, sf).withColumn("k", F.col("account_number").cast("long"))
    homes = homes.select(
        F.when(F.col("k") % 50 != 7, F.col("account_number")).alias("account_number"),
        F.when(F.col("k") % 10 != 3, F.col("address")).alias("address"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") % 20 == 1, 2).otherwise(F.when(F.col("k") % 20 == 2, 0).otherwise(1)))),
    ).drop("col")
    months = orders.select("year", "month").distinct().where("year <> 1996")
    periods = months.select(
        F.when(F.col("month") != 5, F.col("year")).alias("year"),
        F.when(F.col("month") == 12, 13).when(F.col("month") != 4, F.col("month")).alias("month"),
        F.when(F.col("month") != 6, F.make_date("year", "month", F.lit(1))).alias("start_date"),
    ).union(months.where("month = 7").select("year", "month", F.make_date("year", "month", F.lit(1))))
    names = _services(spark, sf).select("name").where("name <> 'ТКО'")
    services = names.union(names.where("name <> 'ХВС'")).union(names.limit(1).select(F.lit(None).cast("string")))
    key = F.col("o_orderkey")
    return {
        "accounts": homes,
        "periods": periods,
        "services": services,
        "charges": lines.select(
            F.when(F.col("l_linenumber") != 7, F.col("account_number")).alias("account_number"),
            F.when(F.col("l_linenumber") != 6, F.col("year")).alias("year"),
            F.when(F.col("l_linenumber") != 5, F.col("month")).alias("month"),
            F.when(F.col("l_linenumber") != 4, F.col("service")).alias("service"),
        ),
        "account_period_info": orders.select(
            F.when(key % 5 != 0, F.col("account_number")).alias("account_number"),
            F.when(key % 7 != 0, F.col("year")).alias("year"),
            F.when(key % 3 != 0, F.col("month")).alias("month"),
        ),
        "raw_imports": orders.select(
            F.when(key % 4 != 0, F.lit("email")).alias("source_type"), F.when(key % 3 != 0, F.col("account_number")).alias("account_number")
        ),
        "address_analysis": sample.analysis_log(spark, sf).select(
            *[F.when(F.col("seq") % n != 0, F.col(c)).alias(c) for n, c in enumerate(("address", "year", "month", "prompt", "response", "model"), 2)]
        ),
    }


@query
def planted_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Violations in tables that break every constraint, from the merged counts of two batches of each."""
    counts = {}
    for name, rows in planted_tables(spark, sf).items():
        side = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
        counts[name] = checks.merged_counts([checks.table_counts(name, rows.where(side == k)) for k in (0, 1)])
    return checks.table_checks(counts)


@query
def charges_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Stored charges of the first lines of all bills, and the other lines put over them."""
    rows = upsert.charge_rows(sample.charge_lines(spark, sf))
    stored = upsert.latest_wins(rows.where("l_linenumber <= 2"), upsert.CHARGE_KEY, sample.ARRIVAL)
    charges = upsert.replace_rows(stored, rows.where("l_linenumber > 2"), upsert.CHARGE_KEY, sample.ARRIVAL)
    return charges.select("account_number", "year", "month", "service", *_double("quantity", "amount_due"))


# Listings


@query
def addresses_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.listed_addresses(sample.billed_accounts(spark, sf))


@query
def accounts_by_address(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.accounts_by_address(sample.billed_accounts(spark, sf))


@query
def addresses_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """Listed addresses where some accounts store theirs padded and some a blank one."""
    key = F.col("account_number").cast("long")
    padded = F.when(key % 7 == 0, F.lit("   ")).when(key % 3 == 0, F.concat(F.lit("  "), "address", F.lit(" "))).otherwise(F.col("address"))
    return aggregates.listed_addresses(sample.billed_accounts(spark, sf).withColumn("address", padded))


@query
def accounts_first_bill(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts whose bills name different flats: the first bill by date decides."""
    bills = sample.bills(spark, sf)
    flat = F.concat("address", F.lit(", кв. "), (F.col("o_orderkey") % 3).cast("string"))
    rows = upsert.account_rows(bills.withColumn("address", flat), ("o_orderdate", "o_orderkey"))
    return rows.select("account_number", "address")


@query
def services_first_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Services whose lines name different units: the first line to arrive decides."""
    lines = sample.charge_lines(spark, sf).withColumn("unit", F.concat(F.lit("ед. "), (F.col("l_suppkey") % 5).cast("string")))
    arrival = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return upsert.service_rows(lines, arrival).select("name", "unit")


@query
def services_list(spark: SparkSession, sf: str) -> DataFrame:
    return _services(spark, sf).select("name", "unit").orderBy("name")


@query
def periods_for_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Months with charges for each account, newest first."""
    lines = sample.charge_lines(spark, sf).select("account_number", "year", "month")
    return aggregates.newest_first(aggregates.charged_periods(lines, ("account_number",)))


# Questions about one address

ASKED_ADDRESS, ASKED_PERIOD = "NATION_19, MACHINERY", (1999, 6)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the asked address, from the lines of its accounts alone."""
    accounts = aggregates.accounts_by_address(sample.billed_accounts(spark, sf), ASKED_ADDRESS)
    lines = aggregates.of_accounts(sample.charge_lines(spark, sf), accounts)
    return aggregates.month_services(aggregates.at_addresses(upsert.upsert_charges(lines, sample.ARRIVAL), accounts))


@query
def asked_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Months in which any of the accounts of an address was charged, newest first."""
    accounts = aggregates.accounts_by_address(sample.billed_accounts(spark, sf), ASKED_ADDRESS)
    lines = aggregates.of_accounts(sample.charge_lines(spark, sf), accounts)
    return aggregates.newest_first(aggregates.charged_periods(lines))


@query
def asked_month(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of an address in one month, by service."""
    year, month = ASKED_PERIOD
    rows = aggregates.with_analysis_tariff(_asked(spark, sf)).where((F.col("year") == year) & (F.col("month") == month))
    return rows.orderBy("service").select("address", "service", *_double("quantity", "amount_due"), "tariff")


@query
def asked_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last twelve charged months of an address up to one month, newest first, by service."""
    upto = _asked(spark, sf).where(aggregates.before(ASKED_PERIOD, inclusive=True))
    newest = aggregates.newest_first(aggregates.charged_periods(upto)).limit(history.HISTORY)
    rows = upto.join(newest, ["year", "month"], "left_semi").orderBy(F.desc("year"), F.desc("month"), "service")
    return rows.select("year", "month", "service", *_double("amount_due"))


# Sums and history


@query
def address_month_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _breakdown(spark, sf).select(
        "address", "year", "month", "name", "unit", *_double("quantity", "amount_due")
    )


@query
def breakdown_units(spark: SparkSession, sf: str) -> DataFrame:
    """The breakdown where one service has a unit, one an empty one and the others none."""
    unit = F.when(F.col("name") == "ХВС", F.lit("м3")).when(F.col("name") == "ТКО", F.lit(""))
    rows = aggregates.month_breakdown(_months(spark, sf), _services(spark, sf).withColumn("unit", unit))
    return rows.groupBy("name", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_due").cast("double").alias("amount_due"))


@query
def address_month_service(spark: SparkSession, sf: str) -> DataFrame:
    months = aggregates.with_analysis_tariff(_months(spark, sf))
    return months.select(
        "address", "year", "month", "service", *_double("quantity"), "tariff", *_double("amount_due")
    )


@query
def previous_period(spark: SparkSession, sf: str) -> DataFrame:
    return history.previous_periods(_charged(spark, sf))


@query
def month_over_month(spark: SparkSession, sf: str) -> DataFrame:
    both = history.month_over_month(_months(spark, sf))
    return both.select(
        "address", "year", "month", "prev_year", "prev_month", "service", *_double("amount", "prev_amount")
    )


@query
def trailing_12_months(spark: SparkSession, sf: str) -> DataFrame:
    return history.trailing_months(_months(spark, sf)).withColumn(
        "amount_due", F.col("amount_due").cast("double")
    )


@query
def trailing_12_map(spark: SparkSession, sf: str) -> DataFrame:
    """History of each address-month as one text, months and services in order."""
    rows = history.month_rows(_months(spark, sf)).withColumn(
        "ym", text.month_label(F.col("year"), F.col("month"))
    )
    seen = F.collect_list(F.struct("ym", "items")).over(history.trailing_window())

    def month(m):
        lines = F.transform(
            m["items"],
            lambda x: F.concat(x["service"], F.lit("="), x["amount_due"].cast("decimal(38,2)").cast("string")),
        )
        return F.concat(m["ym"], F.lit(":"), F.array_join(lines, ","))

    return rows.withColumn("seen", seen).select(
        "address",
        "ym",
        F.size("seen").alias("n_months"),
        F.array_join(F.transform("seen", month), ";").alias("history"),
    )


# Chart


@query
def chart_long(spark: SparkSession, sf: str) -> DataFrame:
    return _chart(spark, sf).select(
        "address", "label", "service", *_double("amount", "quantity"), "tariff"
    )


@query
def month_totals(spark: SparkSession, sf: str) -> DataFrame:
    return chart.chart_totals(_chart(spark, sf)).select("address", "label", *_double("total"))


@query
def chart_json(spark: SparkSession, sf: str) -> DataFrame:
    """Series of each address and service with the numbers joined to text."""
    series = chart.chart_series(_chart(spark, sf))

    def joined(name: str, type_name: str):
        return F.array_join(F.transform(name, lambda x: x.cast(type_name).cast("string")), ",").alias(name)

    return series.select(
        "address",
        "service",
        F.array_join("months", ",").alias("months"),
        joined("amounts", "decimal(38,2)"),
        joined("quantities", "decimal(38,3)"),
        F.size("tariffs").alias("n_tariffs"),
    )


@query
def chart_payload(spark: SparkSession, sf: str) -> DataFrame:
    in_range = _periods(spark, sf).where(aggregates.in_range(CHART_START, CHART_END))
    return chart.chart_payload(_chart(spark, sf), sample.billed_accounts(spark, sf), in_range)


@query
def chart_payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a consumer reads from the payloads."""
    return chart.payload_rows(chart_payload(spark, sf))


@query
def chart_of_services(spark: SparkSession, sf: str) -> DataFrame:
    """The chart of two chosen services at every address."""
    long = chart.chart_long(_located(spark, sf), _periods(spark, sf), CHART_START, CHART_END, ["ХВС", "ТКО"])
    return long.select("address", "label", "service", *_double("amount", "quantity"))


# Analysis and reports


@query
def missing_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.missing_analysis(_charged(spark, sf), sample.analysis_log(spark, sf))


@query
def missing_analysis_topn(spark: SparkSession, sf: str) -> DataFrame:
    queue = analysis.missing_analysis(_charged(spark, sf), sample.analysis_log(spark, sf))
    return analysis.queue_order(queue, QUEUE_LIMIT)


@query
def analysis_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _analyses(spark, sf).select("address", "year", "month", "response", "model", "tokens_used")


@query
def latest_analysis(spark: SparkSession, sf: str) -> DataFrame:
    latest = analysis.latest_analysis(sample.analysis_log(spark, sf), _periods(spark, sf), ("seq",))
    return latest.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query
def latest_analysis_known(spark: SparkSession, sf: str) -> DataFrame:
    """The newest analyses where the periods of one year are not stored."""
    periods = _periods(spark, sf).where("year <> 1995")
    return analysis.latest_analysis(sample.analysis_log(spark, sf), periods, ("seq",)).drop("created_at")


@query
def analysis_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return messages.prompts(_months(spark, sf), sample.analysis_log(spark, sf))


@query
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    bills = sample.bills(spark, sf)
    return messages.reports(bills, _breakdown(spark, sf), _analyses(spark, sf))


# Text functions


@query
def truncate_message(spark: SparkSession, sf: str) -> DataFrame:
    docs = sample.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.truncate_message(F.col("text"))).alias("message_md5"))


@query
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    pages = sample.table(spark, sf, "pages")
    return pages.select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped_md5"))


@query
def markdown_to_html(spark: SparkSession, sf: str) -> DataFrame:
    turns = sample.table(spark, sf, "conversations")
    marked = F.concat(
        F.lit("### "), "role", F.lit("\n**Итог:** "), "text", F.lit("\n  * пункт *важно* & <1>\n- "), "role"
    )
    return turns.select("conv_id", "turn", F.md5(text.markdown_to_html(marked)).alias("html_md5"))


@query
def whitespace_collapse(spark: SparkSession, sf: str) -> DataFrame:
    docs = sample.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("text_md5"))


@query
def html_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = sample.table(spark, sf, "pages")
    return pages.select("page_id", F.md5(text.visible_text(F.col("html"))).alias("text_md5"))


@query
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = sample.table(spark, sf, "documents").select("doc_id", "text")
    found = docs.withColumn("tokens", numbers.valid_tokens(F.col("text")))
    return found.select(
        "doc_id",
        F.size("tokens").alias("n"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        numbers.to_double(F.try_element_at("tokens", F.lit(-2))).alias("before_last"),
        numbers.to_double(F.try_element_at("tokens", F.lit(-1))).alias("last"),
    )


# Bills and mail


@query
def bill_text_fields(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse.parse_texts(_bill_text(spark, sf)).drop("body", "received_at")
    return parsed.withColumn("total_due", F.col("total_due").cast("double"))


@query
def bill_text_services(spark: SparkSession, sf: str) -> DataFrame:
    lines = _bill_text(spark, sf).select(
        "msg_id", F.posexplode(parse.text_services(F.col("body"))).alias("line_idx", "s")
    )
    return lines.select("msg_id", "line_idx", F.col("s.name").alias("name"), "s.quantity", "s.amount_due").select(
        "msg_id", "line_idx", "name", *_double("quantity", "amount_due")
    )


@query
def mail_triage(spark: SparkSession, sf: str) -> DataFrame:
    accepted = mail.is_accepted(TRIAGE)
    return mime.read_messages(sample_mail(spark, sf), bodies=False).select("msg_id", "h_subject", accepted.cast("int").alias("accepted"))


@query
def mail_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = _messages(spark, sf, "body").select("msg_id", F.inline("parts"))
    return parts.select("msg_id", "part_idx", "content_type", F.md5("body").alias("body_md5"))


@query
def bill_html_rows(spark: SparkSession, sf: str) -> DataFrame:
    parts = _messages(spark, sf, "rows").select("msg_id", F.inline("parts"))
    services = parts.where("content_type = 'text/html'").select(
        "msg_id", "part_idx", F.posexplode(parse.html_services(F.col("rows"))).alias("line_idx", "s")
    )
    return services.select(
        "msg_id", "part_idx", "line_idx", F.col("s.name").alias("name"), "s.quantity", "s.amount_due"
    ).select("msg_id", "part_idx", "line_idx", "name", *_double("quantity", "amount_due"))


@query
def bill_first_valid_part(spark: SparkSession, sf: str) -> DataFrame:
    bills = parse.parse_messages(_accepted(spark, sf)).where("bill IS NOT NULL")
    return bills.select(
        "msg_id",
        "bill.part_idx",
        "bill.kind",
        "bill.account_number",
        F.size("bill.services").alias("n_services"),
    )


@query
def bill_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return parse.quarantine(parse.parse_messages(_accepted(spark, sf))).select("msg_id", "reason")


@query
def content_hash_name(spark: SparkSession, sf: str) -> DataFrame:
    docs = sample.table(spark, sf, "documents")
    name = mail.landed_name(F.timestamp_seconds(F.col("doc_id")), F.encode("text", "UTF-8"))
    return docs.select("doc_id", name.alias("name"))


@query
def landed_content(spark: SparkSession, sf: str) -> DataFrame:
    """Names and digests of documents landed as mail, delivered in two parts and then once more as a whole."""
    docs = sample.table(spark, sf, "documents")
    content = F.encode("text", "UTF-8")
    mails = docs.select(
        F.col("doc_id").cast("string").alias("msg_id"), F.timestamp_seconds(F.col("doc_id")).alias("received_at"), content.alias("content")
    )
    path = shared_dir(spark, "landed")
    early = F.col("received_at") < F.timestamp_seconds(F.lit(100))
    later = mails.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 365 DAYS"))
    for delivery in (mails.where(early), mails.where(~early), later):
        mail.land_mail_once(delivery, path)
    return mail.read_landed(spark, path).select(F.col("msg_id").alias("name"), F.md5("content").alias("content_md5"))


def _delivery() -> Column:
    """A number of 0 to 2 for each message, so that deliveries mix early and late arrivals."""
    digit = F.conv(F.substring(F.md5("msg_id"), 1, 1), 16, 10).cast("int")
    return digit % 3


def _ingested(spark: SparkSession, sf: str, deliveries: int = 1, moving: bool = False) -> Store:
    """Land all sample mail, in one or three deliveries with a run of the stream after each, and give the filled store."""
    root = shared_dir(spark, "ingest")
    store = Store(spark, f"{root}/store")
    mails = sample_mail(spark, sf, moving)
    for k in range(deliveries):
        mail.land_mail(mails.where(_delivery() == k) if deliveries > 1 else mails, f"{root}/mail")
        stream = mail.stream_landed(spark, f"{root}/mail")
        start_ingest(store, stream, f"{root}/progress", TRIAGE).awaitTermination()
    return store


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    charges = _ingested(spark, sf).charges()
    return charges.select(
        "account_number", "year", "month", "service", *_double("quantity", "amount_due")
    )


@query
def stream_affected_reports(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).read("reports").drop("batch_id")


@query
def stream_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts whose bills name different flats, from three deliveries out of order: the first bill by arrival decides."""
    return _ingested(spark, sf, 3, moving=True).read("accounts").select("account_number", "address")


@query
def stream_month_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per address, month and service as three deliveries out of order and moving accounts leave them."""
    sums = _ingested(spark, sf, 3, moving=True).month_sums()
    return sums.select("address", "year", "month", "service", *_double("quantity", "amount_due"))


@query
def stream_touched_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of the address-months that the last of three deliveries touches, most of them known before."""
    asked = _ingested(spark, sf, 3).read("prompts")
    last = asked.agg(F.max("version")).scalar()
    return asked.where(F.col("version") == last).select("address", "year", "month", "prompt")


@query
def stream_open_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The work queue after two deliveries whose prompts are all answered, and a third that makes some answers stale."""
    root = shared_dir(spark, "answered")
    store = Store(spark, f"{root}/store")
    mails = sample_mail(spark, sf)
    for k in range(3):
        mail.land_mail(mails.where(_delivery() == k), f"{root}/mail")
        start_ingest(store, mail.stream_landed(spark, f"{root}/mail"), f"{root}/progress", TRIAGE).awaitTermination()
        if k < 2:
            asked = store.read("prompts").where(F.col("version") == k)
            answers = asked.select(
                *analysis.ANALYSIS_KEY, "prompt", F.lit("### ok").alias("response"), F.lit("m").alias("model"),
                F.length("prompt").alias("tokens_used"), F.current_timestamp().alias("created_at"), "version",
            )
            store.save_analyses(k, answers)
            store.compact()
    return open_queue(store).select(*analysis.ANALYSIS_KEY)
