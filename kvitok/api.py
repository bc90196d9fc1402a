"""Questions about a filled store: one address or account list at a time, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvitok.operators import aggregates, analysis, chart, history, messages, upsert
from kvitok.streaming import ingest
from kvitok.streaming.store import LINE_ARRIVAL, Store


class Billing:
    """Lookups, charts, history and the work queue over a store."""

    def __init__(self, store: Store) -> None:
        self.store = store

    # Read at each call, as the store grows while the stream runs.

    @property
    def accounts_table(self) -> DataFrame:
        return self.store.read("accounts").drop("batch_id")

    @property
    def periods_table(self) -> DataFrame:
        return self.store.read("periods").drop("batch_id")

    @property
    def services_table(self) -> DataFrame:
        return self.store.read("services").drop("batch_id")

    # Listings

    def addresses(self) -> DataFrame:
        return aggregates.listed_addresses(self.accounts_table)

    def accounts(self, address: str) -> DataFrame:
        """Accounts at exactly this stored address."""
        if not address:
            return self.accounts_table.limit(0).select("address", "account_number")
        return aggregates.accounts_by_address(self.accounts_table, address)

    def services(self) -> DataFrame:
        return self.services_table.select("service_id", "name", "unit").orderBy("name")

    def periods(self, accounts: list[str]) -> DataFrame:
        """Months in which any of the accounts was charged, newest first."""
        if not accounts:
            return self.periods_table.limit(0).select("year", "month")
        # Which lines win does not change the months that have any.
        lines = aggregates.of_accounts(self.store.lines(), accounts)
        return aggregates.newest_first(aggregates.charged_periods(lines))

    # Charts

    def chart(
        self,
        accounts: list[str],
        start: tuple[int, int],
        end: tuple[int, int],
        services: list[str] | None = None,
    ) -> DataFrame:
        """Month by service matrix of the accounts together; no services means all."""
        if not start or not end:
            raise ValueError("a chart needs a first and a last month")
        kept = aggregates.of_accounts(self.store.lines().drop("unit"), accounts).where(aggregates.in_range(start, end))
        charges = upsert.upsert_charges(kept, LINE_ARRIVAL).withColumn("key", F.lit("all"))
        return chart.chart_long(charges, self.periods_table, start, end, services, key="key")

    def chart_payload(
        self,
        accounts: list[str],
        start: tuple[int, int],
        end: tuple[int, int],
        services: list[str] | None = None,
    ) -> DataFrame:
        """The chart as one JSON text."""
        keys = self.store.spark.range(1).select(F.lit("all").alias("key"))
        months = self.periods_table.where(aggregates.in_range(start, end))
        long = self.chart(accounts, start, end, services)
        return chart.chart_payload(long, keys, months, key="key")

    # History of one address

    def _months(self, address: str) -> DataFrame:
        return self.store.month_sums().where(F.col("address") == address)

    def month(self, address: str, year: int, month: int) -> DataFrame:
        rows = aggregates.with_analysis_tariff(self._months(address))
        return rows.where((F.col("year") == year) & (F.col("month") == month)).orderBy("service")

    def previous_month(self, address: str, year: int, month: int) -> DataFrame:
        """Sums of the latest earlier month that has charges; empty if there is none."""
        earlier = aggregates.with_analysis_tariff(self._months(address)).where(
            aggregates.before((year, month))
        )
        newest = aggregates.newest_first(aggregates.charged_periods(earlier)).limit(1)
        return earlier.join(newest, ["year", "month"], "left_semi").orderBy("service")

    def last_12_months(self, address: str, year: int, month: int) -> DataFrame:
        """Sums of the last twelve charged months up to the given one."""
        upto = self._months(address).where(aggregates.before((year, month), inclusive=True))
        newest = aggregates.newest_first(aggregates.charged_periods(upto)).limit(history.HISTORY)
        return upto.join(newest, ["year", "month"], "left_semi").orderBy(
            F.desc("year"), F.desc("month"), "service"
        )

    # Analysis

    def queue(self, limit: int | None = None) -> DataFrame:
        """Address-months with charges and no analysis of what they are now, newest first."""
        return analysis.queue_order(ingest.queue(self.store).select(*analysis.ANALYSIS_KEY), limit)

    def prompts(self, limit: int | None = None) -> DataFrame:
        """Prompts of the queued address-months; ``version`` goes back with the answer.

        Sums of their addresses alone are read, and texts built for them alone.
        """
        queued = analysis.queue_order(ingest.queue(self.store), limit)
        sums = self.store.month_sums().join(queued.select("address").distinct(), "address", "left_semi")
        texts = messages.prompts(sums, wanted=queued).join(queued, analysis.ANALYSIS_KEY)
        return analysis.queue_order(texts)

    def analysis(self, address: str, year: int, month: int) -> DataFrame:
        """The newest stored analysis of an address-month."""
        if not address or not year or not month:
            raise ValueError("an analysis needs an address, a year and a month")
        rows = self.store.analyses().where(
            (F.col("address") == address) & (F.col("year") == year) & (F.col("month") == month)
        )
        return analysis.latest_analysis(rows, self.periods_table)
