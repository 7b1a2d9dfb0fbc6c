"""The four tables of a retailer, and its invoiced sales without the retailer's own shops."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from functools import cached_property, reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.operators.durable import durable
from clientela.operators.layout import folder_predicate, of_customer, of_customers
from clientela.operators.membership import SKETCHED_KEYS, key_sketch, perhaps_in
from clientela.operators.sizes import BROADCAST_ROWS, key_list_size, may_broadcast
from clientela.params import Channel, Period, Rules

DROP, KEEP, AS_NOT_IN = "drop", "keep", "as_not_in"
BOTH, FIGURES, CONTACTS = "both", "figures", "contacts"


class Ledger:
    """Customers, sales, items and payments of one retailer.

    Own shops among the customers are looked up when the first product needs them, and so are lists of
    customers to narrow sales to; everything else is lazy, so a product reads only the columns and rows it
    needs. Ids with more copies in the customer table than ``many_copies`` are joined without bringing
    their copies together, at the price of looking for them; by default the adaptive skew join is left to it.

    A ledger stands for its tables as they are: what several products need (own shops, scores, order ids) is
    made for the first and kept. Over tables that have changed since, open another.
    """

    def __init__(
        self,
        customers: DataFrame,
        sales: DataFrame,
        items: DataFrame | None = None,
        payments: DataFrame | None = None,
        rules: Rules = Rules(),
        broadcast_rows: int = BROADCAST_ROWS,
        many_copies: int | None = None,
    ):
        self.customers = customers
        self.sales = sales
        self.items = items
        self.payments = payments
        self.rules = rules
        self.broadcast_rows = broadcast_rows
        self.many_copies = many_copies
        self._kept: dict[Hashable, object] = {}

    def kept(self, key: Hashable, make: Callable[[], object]):
        """What ``make`` returns, made once per ledger and ``key``."""
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    @cached_property
    def own_shops(self) -> DataFrame:
        """Ids of customers that are really the retailer's own shops, found once per ledger.

        Written down, so that no product has to read the customer table for them again.
        """
        name = F.upper(F.coalesce("full_name", F.lit("")))
        matches = reduce(or_, (name.like(p) for p in self.rules.own_shop_patterns), F.lit(False))
        found = self.customers.filter(F.col("customer_id").isNotNull() & matches)
        return durable(found.select("customer_id").distinct())

    @cached_property
    def _own_shops_size(self) -> tuple[int, int]:
        return key_list_size(self.own_shops)

    def invoiced(self, channel: Channel | None = None) -> DataFrame:
        """Invoiced sales, own shops included, with the calendar day of the order."""
        sales = self.sales.filter(F.upper("status") == self.rules.invoiced_status)
        if channel is not None:
            sales = sales.filter(channel.predicate())
        return sales.withColumn("day", F.to_date("order_ts"))

    def orders(
        self,
        period: Period | None = None,
        channel: Channel | None = None,
        anonymous: str = DROP,
    ) -> DataFrame:
        """Invoiced sales in the period, without the retailer's own shops.

        ``anonymous`` says what becomes of sales without customer id: ``drop``, ``keep``, or
        ``as_not_in`` – dropped unless there is no own shop at all, as ``NOT IN`` would have it.
        """
        sales = self.invoiced(channel)
        if period is not None:
            sales = self.within(sales, period)
        any_own_shop = self._own_shops_size[0] > 0
        if anonymous == DROP or (anonymous == AS_NOT_IN and any_own_shop):
            sales = sales.filter(F.col("customer_id").isNotNull())
            anonymous = DROP
        if not any_own_shop:
            return sales
        if may_broadcast(self._own_shops_size, self.broadcast_rows):
            return sales.join(F.broadcast(self.own_shops), "customer_id", "left_anti")
        # beyond the bound both sides are shuffled by id. Sales without id match nothing and
        # would meet in one task, so they bypass the join
        known = sales.filter(F.col("customer_id").isNotNull())
        kept = known.join(self.own_shops, "customer_id", "left_anti")
        if anonymous == DROP:
            return kept
        return kept.unionByName(sales.filter(F.col("customer_id").isNull()))

    def orders_of(self, customer_ids: DataFrame, **restrictions) -> DataFrame:
        """:meth:`orders` of the given customers alone.

        The list is written once, since it is measured and then joined; sales are always narrowed to
        it, and its size only decides whether it is broadcast or sales are shuffled by id.
        """
        ids = durable(customer_ids.filter(F.col("customer_id").isNotNull()))
        if may_broadcast(key_list_size(ids), self.broadcast_rows):
            ids = F.broadcast(ids)
        return of_customers(self.orders(**restrictions), ids)

    def only(self, customer_id) -> Ledger:
        """This ledger narrowed to one customer: other folders and row groups of its tables are not read."""
        one = Ledger(
            of_customer(self.customers, customer_id),
            of_customer(self.sales, customer_id),
            self.items,
            self.payments,
            self.rules,
            self.broadcast_rows,
        )
        one.own_shops, one._own_shops_size = self.own_shops, self._own_shops_size
        return one

    def within(self, rows: DataFrame, period: Period) -> DataFrame:
        """Rows of the period by the calendar day of ``order_ts``; days in other folders are not read."""
        inside = rows.filter(period.contains(F.to_date("order_ts")))
        folder = folder_predicate(rows, period)
        return inside if folder is None else inside.filter(folder)

    def order_keys(self, channel: Channel | None = None) -> DataFrame:
        """Orders with an invoiced sale: (order_id, store), and (order_id, NULL) once for each id.

        Found once per ledger and channel, as a table. An id that fills the sales table is one row per
        store before it is shuffled.
        """

        def make() -> DataFrame:
            pairs = self.orders(channel=channel, anonymous=AS_NOT_IN).filter("order_id IS NOT NULL").select("order_id", "store").distinct()
            both = F.array(F.struct("order_id", "store"), F.struct("order_id", F.lit(None).cast(pairs.schema["store"].dataType).alias("store")))
            return durable(pairs.select(F.inline(both)).distinct())

        return self.kept(("order keys", channel), make)

    def of_invoiced_orders(
        self, lines: DataFrame, label: str, sums: list[str], channel: Channel | None = None, by_store: bool = False
    ) -> DataFrame:
        """(order_id, ``label``, ``sums``): sums over the lines of orders with an invoiced sale, by order and label.

        Lines are added up where they are before anything is shuffled, so that an order with very many lines leaves
        a task as one row a label. A short list of orders is sent to the lines; of a longer one first a
        sketch, which rules most other lines out where it can, then the sums meet the list by id.

        With ``by_store`` a line that carries a store belongs to the order of that id and store, and one
        that carries none (or lines without that column) to any order of the id.
        """
        keys = self.order_keys(channel)
        by = ["order_id"]
        if by_store:
            by.append("store")
            lines = lines if "store" in lines.columns else lines.withColumn("store", F.lit(None).cast("string"))
        else:
            keys = keys.filter("store IS NULL").select("order_id")
        rows, width = size = self.kept(("order keys size", channel, by_store), lambda: key_list_size(keys))
        short = may_broadcast(size, self.broadcast_rows)
        keys = keys.select(*(F.col(c).alias(f"_{c}") for c in by))
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "store" else F.col(c) == F.col(f"_{c}") for c in by))
        if short:
            lines = lines.join(F.broadcast(keys), same, "left_semi")
        elif rows <= SKETCHED_KEYS:
            sketch = self.kept(("order keys sketch", channel), lambda: durable(key_sketch(self.order_keys(channel), "order_id")))
            lines = perhaps_in(lines, "order_id", sketch)
        summed = lines.groupBy(*by, label).agg(*(F.sum(c).alias(c) for c in sums))
        return summed if short else summed.join(keys, same, "left_semi")

    @cached_property
    def copied_ids(self) -> DataFrame | None:
        """Customer ids with very many rows in the customer table, found once per ledger.

        None where nobody asked for it (``many_copies``) or there are none, as ids should be unique.
        """
        if self.many_copies is None:
            return None
        copies = self.customers.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").count()
        ids = durable(copies.filter(F.col("count") > self.many_copies).select("customer_id"))
        size = key_list_size(ids)
        if not may_broadcast(size, self.broadcast_rows):
            raise ValueError(f"{size[0]} customer ids have over {self.many_copies} rows; clean the table first")
        return ids if size[0] > 0 else None

    def with_contacts(self, figures: DataFrame, contacts: DataFrame, keep: str = BOTH) -> DataFrame:
        """Join one row of figures per customer with rows of the customer table.

        ``keep`` is ``both`` for customers found on both sides, ``figures`` to keep customers
        missing from the customer table, ``contacts`` to keep customers without figures.
        Contacts without id match nothing and bypass the shuffle; so do the copies of an id that
        has very many, whose one row of figures is sent to them instead.
        """
        how = {BOTH: "inner", FIGURES: "left", CONTACTS: "right"}[keep]
        key = F.col("customer_id")
        known, copied = contacts.filter(key.isNotNull()), self.copied_ids
        if copied is None:
            joined = figures.join(known, "customer_id", how)
        else:
            copied = F.broadcast(copied)
            figures = durable(figures)
            ordinary = figures.join(copied, "customer_id", "left_anti").join(
                known.join(copied, "customer_id", "left_anti"), "customer_id", how
            )
            # at most as many rows as there are copied ids
            few = F.broadcast(figures.join(copied, "customer_id", "left_semi"))
            copies = known.join(copied, "customer_id", "left_semi").join(
                few, "customer_id", "left" if keep == CONTACTS else "inner"
            )
            joined = ordinary.unionByName(copies)
        if keep == CONTACTS:
            joined = joined.unionByName(contacts.filter(key.isNull()), allowMissingColumns=True)
        return joined
