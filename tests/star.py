"""A star schema with everything the generated one lacks: hot keys, repeats, ties, gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from checks.setting import CUSTOMER

CUSTOMERS, ORDERS, LINES = 300, 6000, 12000


def write_hot_star(folder) -> None:
    """A third of all orders is one customer's, a third of all lines one order's."""
    rng = np.random.default_rng(11)

    def write(name: str, **columns) -> None:
        table = pa.Table.from_pandas(pd.DataFrame(columns), preserve_index=False)
        pq.write_table(table, f"{folder}/{name}.parquet", row_group_size=2000)

    write("region", r_regionkey=np.arange(5, dtype="int32"), r_name=[f"R{i}" for i in range(5)])
    write(
        "nation",
        n_nationkey=np.arange(25, dtype="int32"),
        n_name=[f"NATION_{i}" for i in range(25)],
        n_regionkey=np.arange(25, dtype="int32") % 5,
    )
    write("supplier", s_suppkey=np.arange(3))

    keys = np.arange(CUSTOMERS)
    names = np.array([f"Customer#{k:09d}" for k in keys], dtype=object)
    names[keys % 17 == 0] = None
    write(
        "customer",
        c_custkey=keys,
        c_name=names,
        c_nationkey=rng.integers(0, 25, CUSTOMERS).astype("int32"),
    )

    order_keys = np.arange(ORDERS)
    customer = rng.integers(0, CUSTOMERS + 20, ORDERS)  # some are in no customer table
    customer[rng.random(ORDERS) < 1 / 3] = CUSTOMER
    # repeated order ids: in the same store or another, for the same customer or another
    again = (rng.random(ORDERS) < 0.15) & (customer != CUSTOMER)
    again[0] = False
    order_keys[again] = order_keys[np.flatnonzero(again) - 1]
    same_customer = again & (rng.random(ORDERS) < 0.7)
    for i in np.flatnonzero(same_customer):
        if customer[i - 1] != CUSTOMER:
            customer[i] = customer[i - 1]
    customer = pd.array(customer, dtype="Int64")
    customer[rng.random(ORDERS) < 0.05] = pd.NA
    # few distinct moments for most, so that stores tie; the hot customer's are all different
    moments = rng.integers(0, 2400 * 3, ORDERS) * 8 * 3600
    hot = np.asarray(customer.fillna(-1) == CUSTOMER)
    moments[hot] = rng.permutation(2400 * 86400 // 60)[: hot.sum()] * 60
    totals = np.round(rng.gamma(2, 400, ORDERS), 2)
    totals[rng.random(ORDERS) < 0.03] = 0
    totals[rng.random(ORDERS) < 0.03] *= -1
    total = pd.array(totals, dtype="Float64")
    total[rng.random(ORDERS) < 0.02] = pd.NA
    write(
        "orders",
        o_orderkey=order_keys,
        o_custkey=customer,
        o_orderstatus=rng.choice(["F", "F", "O", "P"], ORDERS),
        o_totalprice=total,
        o_orderdate=np.datetime64("1995-01-01", "us") + moments.astype("timedelta64[s]"),
        o_orderpriority=rng.choice(
            ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ORDERS
        ),
    )

    line_order = rng.integers(0, ORDERS, LINES)
    # the hot order has to be an invoiced one of a known customer for its lines to count
    line_order[rng.random(LINES) < 1 / 3] = 4321
    parts = 120
    write(
        "lineitem",
        l_orderkey=line_order,
        l_partkey=rng.integers(0, parts, LINES),
        l_linenumber=rng.integers(1, 8, LINES).astype("int32"),
        l_quantity=rng.integers(1, 50, LINES).astype("float64"),
        l_extendedprice=np.round(rng.gamma(2, 100, LINES), 2),
        l_discount=rng.integers(0, 11, LINES) / 100,
        l_returnflag=rng.choice(["A", "N", "R"], LINES),
        l_linestatus=rng.choice(["F", "O"], LINES),
        l_shipdate=np.datetime64("1999-06-01", "us")
        + (rng.integers(0, 800 * 24, LINES) * 3600).astype("timedelta64[s]"),
    )
    adjectives = np.array(["small", "RED", "red", "large", "hot"])
    write(
        "part",
        p_partkey=np.arange(parts),
        p_name=[f"{adjectives[k % 5]} {'ring' if k % 2 else 'bolt'} {k % 4}" for k in range(parts)],
    )
