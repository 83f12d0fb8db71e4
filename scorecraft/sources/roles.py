"""Role tables: the warehouse tables the reports read, bound over the driver parquet.

Every role is a lazy DataFrame derived from the base tables (lineitem, orders,
part, customer, supplier, nation, events), so its size grows with the data.
Money stays ``decimal`` until a report casts its final sums to double; that
keeps sums exact and independent of the order in which partitions are added.

The bindings are deterministic expressions of the base columns; the same
definitions are written independently in DuckDB SQL for the oracle.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.functions.money import scaled, to_decimal, total
from scorecraft.sources.calendar import build_calendar
from scorecraft.sources.load_roles import LOAD_ROLES, line_item_extras, research_extras, research_pricing_rows
from scorecraft.sources.tables import COMPRESSION, bucketed, own_path

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def money(c: str) -> Column:
    return F.col(c).cast("decimal(15,2)")


def rate(c: str) -> Column:
    return F.col(c).cast("decimal(4,2)")


def line_key() -> Column:
    """Line item id: several fact rows may share one (the fact has a row per event)."""
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


class Warehouse:
    """Named access to base tables and role tables for one data directory.

    ``Warehouse(spark, sf_dir).role("txn")`` names a table as the reports do;
    roles are built lazily and memoised, so a report that reads a role twice
    shares one logical plan.
    """

    # role plans are pure functions of the base tables: share them across
    # Warehouse objects of one session so each is resolved (analysed) once
    _shared: dict[tuple, dict[str, DataFrame]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.store = store
        self._version = self._fingerprint()
        key = (spark.sparkContext.applicationId, self.sf_dir, self._version, store)
        self._cache: dict[str, DataFrame] = Warehouse._shared.setdefault(key, {})
        self._views: Warehouse | None = None

    def prepare(self) -> Warehouse:
        """The same warehouse with shared roles stored as tables on first use.

        Without it every role is a lazy view and building a plan runs no job.
        With it, the roles that many steps of many reports read
        (``STORED_ROLES``) are written once per session under
        ``spark.checkpoint.dir``: the de-duplication of lines and the fact's
        joins then run once instead of once per use, and lineage is cut there.
        """
        return Warehouse(self.spark, self.sf_dir, store=os.environ.get("SCORECRAFT_MATERIALIZE", "1") != "0")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _fingerprint(self) -> str:
        """Digest of the input files' names, sizes and times: other data in the same folder are another version."""
        seen = [self.sf_dir]
        for name in BASE_TABLES:
            where, fs = self._fs(f"{self.sf_dir}/{name}.parquet")
            if not fs.exists(where):
                continue
            files = fs.listFiles(where, True)
            while files.hasNext():
                f = files.next()
                seen.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
        return hashlib.sha1("|".join(sorted(seen)).encode()).hexdigest()[:16]

    # -- A1: named-table scan -------------------------------------------
    def base(self, name: str) -> DataFrame:
        key = "base:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[key]

    def role(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = ROLE_BUILDERS[name](self)
            if self.store and name in STORED_ROLES:
                if name in NARROW:  # its rows are kept in the columns that they are computed from
                    rows, columns = NARROW[name]
                    df = self._stored(f"{name}-rows", rows(self), STORED_ROLES[name])
                    df = df.select(*columns(), *[c for c in (MONTH,) if name in MONTHLY])
                else:
                    df = self._stored(name, df, STORED_ROLES[name])
                if name in MONTHLY:  # reports see the role's own columns; ``during`` reads the folders
                    self._cache["monthly:" + name] = df
                    df = df.drop(MONTH)
            self._cache[name] = df
        return self._cache[name]

    def once(self, name: str) -> DataFrame:
        """A role for a query that reads it once: the stored table if there is one already, else a view.

        Of a view only the columns that the query uses are scanned and dealt; storing
        the role first would deal and write all of them for this one reader.
        """
        if not self.store or name in self._cache:
            return self.role(name)
        if self._views is None:
            self._views = Warehouse(self.spark, self.sf_dir)
        return self._views.role(name)

    def rows(self, name: str) -> DataFrame:
        """What a role's columns are computed from, for a query that carries rows far and computes the columns at the end."""
        return ROWS[name](self)

    def during(self, name: str, start, end, once: bool = False) -> DataFrame:
        """Rows of a role whose day lies in [start, end], the fact read from the folders of those months only.

        ``start`` and ``end`` are dates or columns.  Bounds that fold to constants
        prune the folders in the plan; bounds that are subqueries or come from a
        join prune them at run time.  Without stored folders it is the plain filter;
        ``once``: the query reads the role once, so none are made for it.
        """
        df = self.once(name) if once else self.role(name)
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
        day = F.col(DAYS[name]).between(first, last)
        stored = self._cache.get("monthly:" + name)
        if stored is None:
            return df.filter(day)
        return stored.filter(F.col(MONTH).between(F.trunc(first, "month"), last) & day).drop(MONTH)

    def _stored(self, name: str, df: DataFrame, how: tuple[str, ...] | str | None) -> DataFrame:
        """Write a role once and read it back, clustered by columns or in buckets of a key.

        By default the table has a path of its own, removed when the session's
        JVM ends.  When the session names a shared warehouse folder
        (``scorecraft.warehouse.path``), a complete table of the same input
        files is reused across applications; a new one is written beside it
        and takes its name when it is complete, so a reader never meets half
        a table and two writers never touch each other's files.
        """
        shared = self.spark.conf.get("scorecraft.warehouse.path", None)
        role = name.removesuffix("-rows")
        if isinstance(how, str) and not shared:
            return bucketed(df, name.replace("-", "_"), how, dealt=name in DEALT)
        folders = [MONTH] if role in MONTHLY else []
        if folders:
            df = _by_month(df, DAYS[role], how or ())
        elif how:
            by = (how,) if isinstance(how, str) else how
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
        if not shared:
            path = own_path(self.spark, name)
            df.write.partitionBy(*folders).option("compression", COMPRESSION).parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        final = f"{shared.rstrip('/')}/{self._version}/{name}{'-by-month' if folders else ''}"
        done, fs = self._fs(f"{final}/_SUCCESS")
        if not fs.exists(done):
            mine = f"{final}-{uuid.uuid4().hex}"
            df.write.partitionBy(*folders).option("compression", COMPRESSION).parquet(mine)
            if not fs.rename(self._fs(mine)[0], self._fs(final)[0]) and not fs.exists(done):
                final = mine
        return self.spark.read.schema(df.schema).parquet(final)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLE_BUILDERS:
            return self.role(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)


def _by_month(df: DataFrame, day: str, then: tuple[str, ...]) -> DataFrame:
    """``df`` with the first day of its month, laid out for a write into one folder a month.

    One pass: rows are dealt by month and AQE rebalances the write by size (a month
    that holds a third of the rows is split over many tasks, small months share one),
    so the joins below run once; a range cut would run them again for its sample.
    Files are sorted by day, so a day's filter skips row groups inside its month.
    """
    df = df.withColumn(MONTH, F.trunc(day, "month"))
    return df.hint("rebalance", MONTH).sortWithinPartitions(MONTH, day, *[c for c in then if c != day])


# ---------------------------------------------------------------------------
# Fact and line roles
# ---------------------------------------------------------------------------

def _txn_rows(w: Warehouse) -> DataFrame:
    """One row per lineitem row, lineitem ⨝ orders ⨝ part: what the fact's columns are computed from."""
    l = w.base("lineitem")
    o = w.base("orders").select("o_orderkey", "o_custkey")
    p = w.base("part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return (
        l.join(o, l.l_orderkey == o.o_orderkey, "inner")
        .join(p, l.l_partkey == p.p_partkey, "inner")
        .select(
            line_key().alias("line_item_id"), "l_suppkey", "o_custkey", "l_partkey", "p_size", "p_brand", "p_retailprice",
            F.col("l_shipdate").cast("date").alias("transaction_date"),
            "l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        )
    )


def _txn_columns() -> list[Column]:
    revenue = money("l_extendedprice") * (F.lit(1) - rate("l_discount"))
    price_c = scaled(F.col("l_extendedprice"), 2)
    rev_e4 = price_c * (F.lit(100) - scaled(F.col("l_discount"), 2))
    tax_c = scaled(F.col("l_tax"), 2)
    cat = (F.when(F.col("p_size") <= 25, F.lit(2))
           .when(F.col("p_size") > 45, F.lit(3))
           .otherwise(F.lit(1)))
    return [
        F.col("line_item_id"),
        F.col("l_suppkey").alias("vendor_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("item_id"),
        cat.alias("product_category_id"),
        F.col("p_size").alias("class_id"),
        (F.col("p_size") % 7).alias("modality_id"),
        F.col("p_brand").alias("oem_id"),
        F.col("transaction_date"),
        F.lit(1).alias("requests"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("orders"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returns"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        revenue.alias("revenue"),
        (revenue * rate("l_tax")).alias("margin"),
        F.col("p_retailprice").cast("decimal(15,2)").alias("oem_price"),
        money("l_extendedprice").alias("price"),
        (money("l_extendedprice") * F.lit(0.8).cast("decimal(2,1)")).alias("cost"),
        (F.col("l_partkey") % 40).alias("sourced_by_id"),
        (F.col("o_custkey") % 25).cast("int").alias("sales_rep_id"),
        # the same money as scaled integers (exact, codegen-friendly)
        rev_e4.alias("revenue_e4"),
        (rev_e4 * tax_c).alias("margin_e6"),
        (rev_e4 * 100 - rev_e4 * tax_c).alias("spend_e6"),
        price_c.alias("price_e2"),
        scaled(F.col("p_retailprice"), 2).alias("oem_price_e2"),
        (price_c * 8).alias("cost_e3"),
    ]


def _txn(w: Warehouse) -> DataFrame:
    """One row per lineitem row; lineitem ⨝ orders ⨝ part."""
    return _txn_rows(w).select(*_txn_columns())


def _line_rows(w: Warehouse) -> DataFrame:
    """First lineitem row per line id, ordered by (partkey, suppkey).

    A grouped min over a struct: partial aggregation on the map side, one
    shuffle on the line id, no sort of whole groups (a hot line id costs
    one running minimum, not a sorted group).
    """
    l = w.base("lineitem").withColumn("line_item_id", line_key())
    first = F.min(F.struct(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )).alias("r")
    return l.groupBy("line_item_id").agg(first).select("line_item_id", "r.*")


def _line_detail(w: Warehouse) -> DataFrame:
    """One row per line id."""
    r = w.role("line_rows")
    p = w.base("part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    ln = F.col("l_linenumber")
    stripped = F.upper(F.translate(F.col("p_name"), " ", ""))
    backordered = F.col("l_discount") >= 0.08
    return (
        r.join(p, r.l_partkey == p.p_partkey, "inner")
        .select(
            "line_item_id",
            F.col("l_partkey").alias("item_id"),
            F.col("l_partkey").alias("pim_item_number"),
            F.col("l_suppkey").alias("vendor_id"),
            (ln % 2).alias("smart_price_selected"),
            F.when(ln % 3 == 0, 1).otherwise(0).alias("smart_sourced"),
            (F.col("p_size") % 2).alias("photo_shown"),
            F.when(F.col("l_quantity") > 10, 1).otherwise(0).alias("smart_order_po"),
            F.when(F.col("l_quantity") > 20, 1).otherwise(0).alias("smart_order_conf"),
            (ln % 2).alias("smart_price_presented"),
            F.when(ln == 7, F.lit(7)).alias("contract_pro_id"),
            F.when(backordered, F.col("l_shipdate").cast("date")).alias("backorder_ship_date"),
            F.when(backordered, 1).otherwise(0).alias("ever_backordered"),
            F.concat("l_returnflag", "l_linestatus").alias("condition_code"),
            F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("return_required"),
            F.col("p_name").alias("requested_part_number"),
            stripped.alias("requested_part_number_stripped"),
            F.when(ln % 2 == 0, F.concat(F.col("p_name"), F.lit("X"))).alias("replacement_part_number"),
            F.when(ln % 2 == 0, F.concat(stripped, F.lit("X"))).alias("replacement_part_number_stripped"),
            F.col("p_type").alias("line_item_description"),
            ln.alias("line_item_status_id"),
            F.concat(F.lit("PO"), F.col("l_orderkey").cast("string")).alias("line_item_po"),
            F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("model_number"),
            F.when(ln <= 2, "90 DAY").otherwise("NONE").alias("warranty_description"),
            ((F.col("l_partkey") + ln) % 500).alias("price_rule_id"),
        )
    )


def _line_status(w: Warehouse) -> DataFrame:
    """Ordered = order date, closed = +3h per line number."""
    r = w.role("line_rows").select("line_item_id", "l_orderkey", "l_linenumber", "l_discount")
    o = w.base("orders").select("o_orderkey", "o_orderdate")
    closed = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber") * 3)
    return r.join(o, r.l_orderkey == o.o_orderkey, "inner").select(
        "line_item_id",
        F.col("o_orderdate").alias("first_ordered_timestamp"),
        F.when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(closed).alias("first_closed_timestamp"),
        F.when(F.col("l_discount") >= 0.08, F.col("o_orderdate") + F.make_dt_interval(F.lit(1)))
        .alias("first_backordered_timestamp"),
    )


def _tracking(w: Warehouse) -> DataFrame:
    """Leg 1 for every line, a leg 2 for line number 1."""
    r = w.role("line_rows").select("line_item_id", "l_orderkey", "l_linenumber", "l_shipdate")
    o = w.base("orders").select("o_orderkey", "o_orderdate")
    j = r.join(o, r.l_orderkey == o.o_orderkey, "inner")
    leg1 = j.select(
        "line_item_id",
        F.lit(1).alias("shipment_leg_id"),
        F.when(F.col("l_linenumber") == 3, F.lit(None))
        .otherwise(F.concat(F.lit("TRK"), F.col("line_item_id").cast("string"))).alias("tracking_number"),
        F.when(F.col("l_orderkey") % 2 == 0, "Y").otherwise("N").alias("auto_label"),
        F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate")).alias("date_delivered"),
    )
    leg2 = j.filter(F.col("l_linenumber") == 1).select(
        "line_item_id",
        F.lit(2).alias("shipment_leg_id"),
        F.concat(F.lit("RTN"), F.col("line_item_id").cast("string")).alias("tracking_number"),
        F.lit("Y").alias("auto_label"),
        F.col("l_shipdate").alias("date_delivered"),
    )
    return leg1.unionByName(leg2)


def _shipping_info(w: Warehouse) -> DataFrame:
    r = w.role("line_rows").select("line_item_id", "l_orderkey")
    o = w.base("orders").select("o_orderkey", "o_orderpriority")
    return r.join(o, r.l_orderkey == o.o_orderkey, "inner").select(
        "line_item_id", F.col("o_orderpriority").alias("shipping_method"))


# Shipping method name -> shipping method id.
SHIP_METHOD_IDS = {"1-URGENT": 11, "2-HIGH": 6, "3-MEDIUM": 59, "4-NOT SPECIFIED": 24}


def _ship_methods(w: Warehouse) -> DataFrame:
    """Distinct method names that carry an id (bounded by the code list)."""
    sid = F.lit(None).cast("int")
    for name, i in SHIP_METHOD_IDS.items():
        sid = F.when(F.col("shipping_method") == name, F.lit(i)).otherwise(sid)
    return (w.base("orders").select(F.col("o_orderpriority").alias("shipping_method")).distinct()
            .select("shipping_method", sid.alias("shipping_method_id"))
            .filter(F.col("shipping_method_id").isNotNull()))


def _returns(w: Warehouse) -> DataFrame:
    """One return per lineitem row flagged R or A."""
    l = w.base("lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    resp = F.element_at(F.array(*[F.lit(c) for c in "CPVNSX"]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return l.select(
        line_key().alias("line_item_id"),
        F.concat_ws("-", F.lit("RGA"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("rga_number"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("rga_type_id"),
        resp.alias("responsibility"),
        (F.col("l_partkey") % 60).cast("int").alias("return_reason_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(F.col("l_tax") < 0.07, "Y").otherwise("N").alias("active"),
        F.col("l_linenumber").alias("status_id"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(1), F.lit(12))).alias("created_timestamp"),
        F.when(F.col("l_returnflag") == "A",
               F.col("l_orderkey") * 10 + (F.col("l_linenumber") % 7 + 1)).alias("salvage_line_item_id"),
    )


def _research_rows(w: Warehouse) -> DataFrame:
    """What a quote's columns are computed from: its row of lineitem and its id."""
    return w.base("lineitem").withColumn("research_id", _research_key())


def research_columns() -> list[Column]:
    ln = F.col("l_linenumber")
    rtype = F.element_at(F.array(*[F.lit(c) for c in ("SP", "SS", "SPP", "MAN", "EX")]),
                         ((F.col("l_partkey") + ln) % 5 + 1).cast("int"))
    result = F.element_at(F.array(*[F.lit(c) for c in ("HP", "EHP", "NP", "NQ")]),
                          ((F.col("l_partkey") + F.col("l_suppkey")) % 4 + 1).cast("int"))
    price = money("l_extendedprice")
    price_c = scaled(F.col("l_extendedprice"), 2)
    tax_c = scaled(F.col("l_tax"), 2)
    outright = (F.when(ln == 1, F.lit(None))
                .when(ln == 2, F.lit(0).cast("decimal(15,2)"))
                .otherwise(price * F.lit(0.9).cast("decimal(2,1)")))
    exchange = (F.when(ln == 3, F.lit(None))
                .when(ln == 4, F.lit(0.01).cast("decimal(3,2)"))
                .otherwise(price * (F.lit(1) - rate("l_tax") * 10)))
    return [
        line_key().alias("line_item_id"),
        F.col("l_suppkey").alias("vendor_id"),
        (F.col("l_partkey") % 150).alias("created_user_id"),
        F.date_sub(F.col("l_shipdate").cast("date"), ln).alias("created_date"),
        rtype.alias("research_type_code"),
        ((F.col("l_partkey") + ln) % 4 + 1).cast("int").alias("research_type_id"),
        result.alias("result_code"),
        outright.cast("decimal(17,3)").alias("outright_cost"),
        exchange.cast("decimal(17,3)").alias("exchange_cost"),
        F.col("l_returnflag").alias("condition_code"),
        F.col("l_partkey").alias("part_number_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("research_id"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("inv_item_cost_id"),
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("PIM"), F.col("l_partkey").cast("string"))).alias("rs_item_number"),
        F.when(ln % 2 == 0, F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("X")))
        .alias("replacement_part_number_stripped"),
        (ln % 4).alias("condition_id"),
        (ln % 3).alias("warranty_id"),
        price.alias("outright_price"),
        (price * F.lit(0.75).cast("decimal(3,2)")).alias("exchange_price"),
        F.when(ln == 7, F.lit(7)).alias("contract_pro_id"),
        # the same costs as scaled integers (exact, codegen-friendly)
        F.when(ln == 1, F.lit(None)).when(ln == 2, F.lit(0)).otherwise(price_c * 9).cast("long").alias("outright_e3"),
        F.when(ln == 3, F.lit(None)).when(ln == 4, F.lit(10)).otherwise(price_c * (10 - tax_c)).cast("long")
        .alias("exchange_e3"),
        (price_c * 25).alias("add_bill_unit_e4"),
        *research_extras(),
    ]


def _research(w: Warehouse) -> DataFrame:
    """One quote per lineitem row; some costs missing or at the floor."""
    return _research_rows(w).select(*research_columns())


def _research_key() -> Column:
    return F.concat_ws("-", F.lit("R"), *[F.col(c).cast("string") for c in
                                          ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def _line_item_rows(w: Warehouse) -> DataFrame:
    """Lines with their order's day and their part: what the operational line rows are computed from."""
    r = w.role("line_rows").drop("l_tax", "l_linestatus").withColumnRenamed("line_item_id", "id_no")
    o = w.base("orders").select("o_orderkey", "o_orderdate")
    p = w.base("part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    return (r.join(o, r.l_orderkey == o.o_orderkey, "inner").join(p, r.l_partkey == p.p_partkey, "inner")
            .drop("o_orderkey", "p_partkey"))


def _line_item_columns() -> list[Column]:
    ln = F.col("l_linenumber")
    return [
        F.col("id_no"),
        F.col("p_name").alias("part_number"),
        F.upper(F.translate(F.col("p_name"), " ", "")).alias("part_number_stripped"),
        (F.col("p_size") % 2).alias("photo_shown"),
        F.col("p_type").alias("description"),
        ((F.col("l_partkey") + ln) % 27 + 1).cast("int").alias("status_id"),
        _research_key().alias("vendor_research_id"),
        (F.col("l_orderkey") % 5 + 1).cast("int").alias("order_type_id"),
        F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("return_required"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (ln % 2).alias("return_quantity"),
        F.col("o_orderdate").alias("created_timestamp"),
        (F.col("l_partkey") % 150).alias("created_user_id"),
        F.when(F.col("l_discount") >= 0.08, F.col("l_shipdate").cast("date")).alias("backorder_ship_date"),
        F.when(ln % 2 == 1, "Y").otherwise("N").alias("had_smartpriced_research"),
        (ln % 3).alias("urgency_id"),
        *line_item_extras(),
    ]


def _line_items(w: Warehouse) -> DataFrame:
    """Operational line rows; the chosen quote is the line's first row."""
    return _line_item_rows(w).select(*_line_item_columns())


def _confirmations(w: Warehouse) -> DataFrame:
    l = w.base("lineitem")
    return l.select(line_key().alias("line_item_id"), F.col("l_shipdate").alias("created_timestamp"),
                    (F.col("l_partkey") % 150).alias("confirmed_by_id"),
                    F.concat(F.lit("conf "), F.col("l_suppkey").cast("string")).alias("confirmation_notes"))


def _invoices(w: Warehouse) -> DataFrame:
    l = w.base("lineitem")
    return l.select(line_key().alias("line_item_id"),
                    F.concat(F.lit("INV"), F.col("l_orderkey").cast("string")).alias("invoice_number"),
                    (F.col("l_linenumber") - 1).alias("line_number"))


def _received_parts(w: Warehouse) -> DataFrame:
    l = w.base("lineitem").filter(F.col("l_returnflag") == "N")
    return l.select(line_key().alias("line_item_id"), F.col("l_suppkey").alias("received_by_contact_id"),
                    F.date_add(F.col("l_shipdate").cast("date"), 3).alias("date_received"))


def _admin_actions(w: Warehouse) -> DataFrame:
    l = w.base("lineitem")
    return l.select(line_key().alias("line_item_id"), (F.col("l_linenumber") % 5).alias("action_type_id"))


# Small code tables of the line-item load.
CONDITION_CODES = ("NO", "NF", "RF", "AF")
WARRANTY_CODES = ("30 DAY", "90 DAY", "1 YEAR")
URGENCY_CODES = ("LOW", "MED", "HIGH")


def _code_table(w: Warehouse, key: str, labels, label_col: str, modulo: int) -> DataFrame:
    ids = w.spark.range(modulo).select(F.col("id").cast("int").alias(key))  # the codes are fixed values
    return ids.select(key, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(key) + 1).alias(label_col))


def _condition_codes(w: Warehouse) -> DataFrame:
    codes = _code_table(w, "condition_id", CONDITION_CODES, "condition_code", 4)
    return codes.withColumn("web_display_code", F.concat(F.lit("W"), F.col("condition_code")))


def _warranty_codes(w: Warehouse) -> DataFrame:
    return _code_table(w, "warranty_id", WARRANTY_CODES, "description", 3)


def _urgency_codes(w: Warehouse) -> DataFrame:
    return _code_table(w, "urgency_id", URGENCY_CODES, "urgency_code", 3)


# ---------------------------------------------------------------------------
# Dimension roles
# ---------------------------------------------------------------------------

def _vendors(w: Warehouse) -> DataFrame:
    s = w.base("supplier")
    k = F.col("s_suppkey")
    has_mgr = k % 5 != 4
    return s.select(
        k.alias("company_id"),
        F.col("s_name").alias("company_name"),
        F.when(has_mgr, F.col("s_nationkey")).alias("relationship_manager_id"),
        F.when(has_mgr, F.concat(F.lit("Manager "), F.col("s_nationkey").cast("string"))).alias("relationship_manager"),
        F.element_at(F.array(F.lit("OEM"), F.lit("IND"), F.lit("REF")), (k % 3 + 1).cast("int")).alias("company_type_code"),
        F.concat(F.lit("T"), (k % 4).cast("string")).alias("tier_code"),
        F.when(k % 4 == 0, "NET30").when(k % 4 == 1, "2%10 NET 45").when(k % 4 == 2, "COD").alias("payment_term_code"),
        F.when(k % 6 == 5, F.lit(None)).otherwise(F.lit(25200) + (k % 9) * 3600).cast("int").alias("vend_cutoff_est"),
        F.when(k % 10 == 9, "N").otherwise("Y").alias("active"),
        F.when(k % 2 == 0, "Y").otherwise("N").alias("smart_order_enabled"),
        F.when(k % 3 == 0, "Y").otherwise("N").alias("smart_label_enabled"),
        F.when(F.col("s_acctbal") > 0, "Y").otherwise("N").alias("epv_member"),
        (k % 3 + 1).cast("int").alias("choice_level"),
        F.when(F.col("s_acctbal") < -500, "Y").otherwise("N").alias("suspend_vendor"),
        F.when(F.col("s_nationkey") % 4 == 0, "Y").otherwise("N").alias("redirect_shipments"),
    )


def _customers(w: Warehouse) -> DataFrame:
    c = w.base("customer")
    n = w.base("nation").select("n_nationkey", "n_name")
    seg = F.col("c_mktsegment")
    segment = (F.when(seg == "AUTOMOBILE", " enterprise")
               .when(seg == "BUILDING", "SODEXO")
               .otherwise("Healthcare"))
    sub = (F.when(seg == "FURNITURE", "provider")
           .when(seg == "HOUSEHOLD", " ISO")
           .when(seg == "MACHINERY", F.when(F.col("c_nationkey") % 2 == 0, "Government"))
           .when(seg == "AUTOMOBILE", F.when(F.col("c_custkey") % 10 == 0, "ARAMARK").otherwise("Direct"))
           .otherwise("Direct"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.col("c_nationkey").cast("bigint").alias("lvl1_company_id"),
        F.col("n_name").alias("lvl1_company_name"),
        segment.alias("segment"),
        sub.alias("sub_segment"),
    )


def _organization(w: Warehouse) -> DataFrame:
    """Internal staff; customers of segment MACHINERY act as staff users."""
    c = w.base("customer")
    return c.filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.col("c_custkey").alias("organization_id"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("user_name"),
    )


def _requestors(w: Warehouse) -> DataFrame:
    """Users that signed up (events)."""
    e = w.base("events")
    return (e.filter(F.col("event_type") == "signup")
            .groupBy(F.col("user_id").alias("requestor_id"))
            .agg(F.min("ts").alias("first_signup"))
            .select("requestor_id",
                    F.concat(F.lit("Requestor "), F.col("requestor_id").cast("string")).alias("requestor_name")))


def _part_numbers(w: Warehouse) -> DataFrame:
    p = w.base("part")
    return p.select(F.col("p_partkey").alias("part_number_id"),
                    F.upper(F.translate(F.col("p_name"), " ", "")).alias("part_number_stripped"))


def _vendor_mapping(w: Warehouse) -> DataFrame:
    l = w.base("lineitem").select("l_suppkey", "l_partkey")
    p = w.base("part").select("p_partkey", "p_brand", "p_size")
    return (l.join(p, l.l_partkey == p.p_partkey, "inner")
            .select(F.col("l_suppkey").alias("vendor_id"), F.col("p_brand").alias("oem_id"),
                    F.col("p_size").alias("model_id"), (F.col("p_size") % 7).alias("modality_id"),
                    F.col("p_size").alias("class_id"))
            .distinct())


def _auto_order(w: Warehouse) -> DataFrame:
    """One setting per (company, ship priority)."""
    o = w.base("orders")
    return (o.groupBy(F.col("o_custkey").alias("vendor_id"),
                      F.substring("o_orderpriority", 1, 1).cast("int").alias("ship_priority_id"))
            .agg(F.min("o_orderstatus").alias("settings"))
            .withColumn("is_auto_order", F.when(F.col("settings") == "F", "Y").otherwise("N")))


# Further numbers of a contact, their prefix, and how often one is missing.
CONTACT_NUMBERS = (("fax", 556, 2), ("direct_line", 557, 3), ("cell_phone", 558, 4), ("alternate_phone", 559, 5),
                   ("alternate_fax", 560, 6), ("pager", 561, 7), ("emergency_phone", 562, 8))


def _contacts(w: Warehouse) -> DataFrame:
    """Customer rows act as contacts of a company."""
    c = w.base("customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("requestor_id"),
        (F.col("c_nationkey") * 4 + k % 4).cast("bigint").alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.lit("First").alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.col("c_mktsegment").alias("position_description"),
        F.concat(F.lit("555-"), (k % 10000).cast("string")).alias("main_phone"),
        F.when(k % 3 != 0, F.concat(F.lit("contact"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("Rep "), F.col("c_nationkey").cast("string")).alias("sales_representative"),
        F.when(k % 4 == 0, F.concat(F.lit("www.site"), F.col("c_nationkey").cast("string"), F.lit(".example"))).alias("website"),
        *[F.when(k % m != 0, F.concat(F.lit(f"{p}-"), (k % 10000).cast("string"))).alias(n) for n, p, m in CONTACT_NUMBERS],
        F.when(F.col("c_acctbal") > 0, "Y").otherwise("N").alias("active"),
        F.when(k % 7 == 0, "N").otherwise("Y").alias("cc_active"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", "Y").otherwise("N").alias("vendor_ind"),
    )


def _items(w: Warehouse) -> DataFrame:
    """One catalogue item per part; every third part is an OEM item."""
    p = w.base("part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("item_number"),
        (k % 100).alias("company_id"),
        F.upper(F.translate(F.col("p_name"), " ", "")).alias("part_number"),
        F.col("p_name").alias("description"),
        F.when(k % 3 == 0, "O").otherwise("V").alias("item_type"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("product_number"),
        F.col("p_brand").alias("oem_name"),
        F.col("p_size").alias("ps_structure_id"),
    )


# Catalogue condition codes (same domain as line condition codes).
CONDITIONS = ("NO", "NF", "RF", "AF")


def _condition_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), (key % 4 + 1).cast("int"))


def _item_prices(w: Warehouse) -> DataFrame:
    """Vendor item -> its OEM item (first of its group of three), prices."""
    p = w.base("part")
    k = F.col("p_partkey")
    base = F.col("p_retailprice").cast("decimal(15,2)")

    def pct(x: str) -> Column:
        return base * F.lit(x).cast("decimal(3,2)")

    return p.select(
        k.alias("item_number"),
        k.alias("search_item_number"),
        (k - k % 3).alias("oem_item_number"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("product_number"),
        base.alias("list_price"),
        pct("0.7").alias("sell_price"),
        pct("1.0").alias("exchange_oem_price"),
        pct("1.2").alias("outright_oem_price"),
        pct("0.5").alias("exchange_cost"),
        pct("0.6").alias("outright_cost"),
        pct("0.7").alias("exchange_price"),
        pct("0.8").alias("outright_price"),
        F.when(F.col("p_size") % 3 == 0, F.lit(100)).otherwise(F.lit(0)).cast("decimal(15,2)").alias("cost_core_charge"),
        F.lit("EA").alias("uom_code"),
        _condition_of(k).alias("condition"),
        F.when(k % 2 == 0, "EX").otherwise("OR").alias("condition_code"),
        F.lit("90 DAY").alias("cost_warranty_description"),
        F.when(F.col("p_size") % 5 == 0, "N").otherwise("Y").alias("is_returnable"),
        (F.col("p_size") % 10).alias("lead_time_days"),
        F.col("p_type").alias("sub_type"),
    )


def _product_structure(w: Warehouse) -> DataFrame:
    """One structure per part size, grouped by tens."""
    return (w.base("part").select(F.col("p_size").alias("structure_id")).distinct()
            .select("structure_id",
                    F.concat(F.lit("Structure "), F.col("structure_id").cast("string")).alias("name"),
                    F.concat(F.lit("Group "), F.floor(F.col("structure_id") / 10).cast("string")).alias("parent_name")))


def _tax_code(size: Column) -> Column:
    return F.concat(F.lit("d"), F.floor(size / 10).cast("string"), F.lit("."), size.cast("string"),
                    F.lit(".0.0.0.0.0"))


def _oem_structure(w: Warehouse) -> DataFrame:
    """Taxonomy codes, one per size plus one per group of ten sizes."""
    sizes = w.base("part").select(F.col("p_size").alias("s")).distinct()
    child = sizes.select(_tax_code(F.col("s")).alias("structure_id"))
    parent = sizes.select(F.concat(F.lit("d"), F.floor(F.col("s") / 10).cast("string"),
                                   F.lit(".0.0.0.0.0.0")).alias("structure_id")).distinct()
    return (child.unionByName(parent)
            .select("structure_id", F.concat(F.lit("Taxonomy "), F.col("structure_id")).alias("name"),
                    F.lit(2).alias("oem_id")))


def _oem_structure_products(w: Warehouse) -> DataFrame:
    """Product number -> taxonomy code."""
    p = w.base("part")
    return p.select(
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("product_number"),
        _tax_code(F.col("p_size")).alias("structure_id"),
        F.when(F.col("p_size") % 10 == 0, F.lit(1)).otherwise(F.lit(2)).alias("oem_id"),
    ).distinct()


def _pim_images(w: Warehouse) -> DataFrame:
    l = w.base("lineitem")
    return l.filter(F.col("l_linenumber") <= 2).select(F.col("l_partkey").alias("item_number"),
                                                       line_key().alias("image_id"))


def _pim_models(w: Warehouse) -> DataFrame:
    """Models of a product, one per supplier that sold it."""
    l = w.base("lineitem").select("l_partkey", "l_suppkey")
    p = w.base("part").select("p_partkey", "p_brand", "p_size")
    return (l.join(p, l.l_partkey == p.p_partkey, "inner")
            .select(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("product_number"),
                    F.concat(F.lit("MDL"), F.col("l_suppkey").cast("string")).alias("model_code"))
            .distinct())


def _pim_searches(w: Warehouse) -> DataFrame:
    """Part numbers searched for an item (with repeats)."""
    l = w.base("lineitem")
    return l.select(F.col("l_partkey").alias("search_item_number"),
                    F.concat(F.lit("REF"), F.col("l_suppkey").cast("string")).alias("part_number"))


def _item_logistics(w: Warehouse) -> DataFrame:
    p = w.base("part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("item_number"),
        F.concat(F.lit("Note "), F.col("p_type")).alias("cust_notes"),
        (F.col("p_size") * 3).alias("quantity_on_hand"),
        F.lit(1).alias("uom_quantity"),
        (F.col("p_size").cast("decimal(10,1)") * F.lit(0.5).cast("decimal(2,1)")).alias("package_weight"),
        _condition_of(k).alias("condition_code"),
    )


def _item_attributes(w: Warehouse) -> DataFrame:
    l = w.base("lineitem").filter(F.col("l_returnflag") == "N")
    return l.select(F.col("l_partkey").alias("item_number"), F.col("l_linenumber").alias("attribute_id"))


def _references(w: Warehouse) -> DataFrame:
    """'also consider' links of an item (type C), sequences 1-3."""
    p = w.base("part").select("p_partkey")
    seq = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("sequence")
    return (p.select("p_partkey", seq)
            .select(F.col("p_partkey").alias("owner"), (F.col("p_partkey") + F.col("sequence")).alias("to"),
                    "sequence", F.when(F.col("sequence") == 3, "X").otherwise("C").alias("type")))


def _formulary(w: Warehouse) -> DataFrame:
    """Each order is a formulary document naming OEM items."""
    l = w.base("lineitem")
    return l.select(F.col("l_orderkey").alias("document_id"),
                    (F.col("l_partkey") - F.col("l_partkey") % 3).alias("o_string"))


def _pricing_rules(w: Warehouse) -> DataFrame:
    p = w.base("part")
    return p.select(
        (F.col("p_partkey") % 500).alias("price_rule_id"),
        F.when(F.col("p_size") % 4 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("prod_seg_part_number"),
    )


# Product category id -> description.
PRODUCT_CATEGORIES = {1: "Imaging", 2: "Biomed", 3: "Stryker"}


def _oems(w: Warehouse) -> DataFrame:
    """OEMS: one row per brand."""
    return (w.base("part").select(F.col("p_brand").alias("company_id")).distinct()
            .withColumn("company_name", F.concat(F.lit("OEM "), F.col("company_id"))))


def _modalities(w: Warehouse) -> DataFrame:
    """Bounded code table (ids 0-6)."""
    return (w.base("part").select((F.col("p_size") % 7).alias("modality_id")).distinct()
            .withColumn("modality_code", F.concat(F.lit("MOD"), F.col("modality_id").cast("string"))))


def _product_classes(w: Warehouse) -> DataFrame:
    return (w.base("part").select(F.col("p_size").alias("class_id")).distinct()
            .withColumn("class_code", F.concat(F.lit("CLASS"), F.col("class_id").cast("string"))))


def _product_categories(w: Warehouse) -> DataFrame:
    cat = (F.when(F.col("p_size") <= 25, F.lit(2)).when(F.col("p_size") > 45, F.lit(3)).otherwise(F.lit(1)))
    desc = F.lit(None).cast("string")
    for k, v in PRODUCT_CATEGORIES.items():
        desc = F.when(F.col("product_category_id") == k, F.lit(v)).otherwise(desc)
    return (w.base("part").select(cat.alias("product_category_id")).distinct()
            .withColumn("product_category_description", desc))


# Budget factor by product category description (others 0.95).
BUDGET_FACTORS = {"Biomed": "1.05", "Stryker": "1.10"}
OTHER_BUDGET_FACTOR = "0.95"
FORECAST_FACTOR = "0.98"
SUPPLEMENT_SHARE = "0.02"


def _daily_actuals(w: Warehouse) -> DataFrame:
    """Fact by day x segment x sub-segment x category."""
    q = w.role("txn")
    c = w.role("customers").select(F.col("company_id").alias("customer_id"), "segment", "sub_segment")
    pc = F.broadcast(w.role("product_categories"))  # bounded code table
    g = (q.join(c, "customer_id", "left").join(pc, "product_category_id", "left")
         .groupBy(F.col("transaction_date").alias("accounting_date"), "segment", "sub_segment",
                  "product_category_description")
         .agg(F.sum("requests").cast("bigint").alias("actual_requests"),
              F.sum("orders").cast("bigint").alias("actual_orders"),
              # integer sums, then exact decimals of bounded precision (products with
              # the budget factors stay exact)
              to_decimal(total("revenue_e4"), 4, 28).alias("actual_revenue"),
              to_decimal(total("margin_e6"), 6, 28).alias("actual_margin")))
    factor = F.lit(OTHER_BUDGET_FACTOR).cast("decimal(3,2)")
    for k, v in BUDGET_FACTORS.items():
        factor = F.when(F.col("product_category_description") == k, F.lit(v).cast("decimal(3,2)")).otherwise(factor)
    fc = F.lit(FORECAST_FACTOR).cast("decimal(3,2)")
    return g.select(
        "accounting_date", F.col("accounting_date").alias("transaction_date"), "segment", "sub_segment",
        "product_category_description", "actual_requests", "actual_orders", "actual_revenue", "actual_margin",
        F.col("actual_requests").alias("budget_requests"), F.col("actual_orders").alias("budget_orders"),
        (F.col("actual_revenue") * factor).alias("budget_revenue"),
        (F.col("actual_margin") * factor).alias("budget_margin"),
        F.col("actual_requests").alias("forecast_requests"), F.col("actual_orders").alias("forecast_orders"),
        (F.col("actual_revenue") * fc).alias("forecast_revenue"),
        (F.col("actual_margin") * fc).alias("forecast_margin"),
    )


def _budget_supplement(w: Warehouse) -> DataFrame:
    return budget_supplement(w, w.role("txn"))


def budget_supplement(w: Warehouse, q: DataFrame) -> DataFrame:
    """BUDGET_IMPORT supplement: a 'Contingency' budget per month of the fact rows ``q``, spread over its workdays."""
    share = F.lit(SUPPLEMENT_SHARE).cast("decimal(3,2)")
    m = q.groupBy(F.last_day("transaction_date").alias("month_end")).agg(
        (to_decimal(total("revenue_e4"), 4, 28) * share).alias("budget_revenue"),
        (to_decimal(total("margin_e6"), 6, 28) * share).alias("budget_margin"))
    days = F.broadcast(w.role("calendar").groupBy("month_end").agg(F.sum("workday_ind").alias("days")))
    return m.join(days, "month_end", "left").select(
        F.lit("Contingency").alias("segment"), F.lit(6).alias("sort"), "month_end", "budget_revenue",
        "budget_margin", F.lit(0).cast("decimal(15,2)").alias("revenue"),
        F.lit(0).cast("decimal(15,2)").alias("margin"), "days")


def _calendar(w: Warehouse) -> DataFrame:
    return build_calendar(w.base("orders"), w.base("lineitem"))


#: The day of the roles that ``during`` reads.  The fact is stored in one folder a month; the daily
#: actuals, bounded by days and segments, are one small table whose filter is pushed into its scan.
DAYS = {"txn": "transaction_date", "daily_actuals": "accounting_date"}
MONTHLY = ("txn",)
MONTH = "month_start"

#: Stored roles: None as they are, columns to cluster by (inside a month for the monthly ones), or the key of their buckets.
#: A quote (``research``) is a wide row computed from one row of lineitem alone: reports take the few columns they
#: need from the scan, which costs less than to deal, sort and write all of them.
STORED_ROLES = {"calendar": None, "line_rows": "line_item_id", "line_items": "id_no", "confirmations": "line_item_id", "txn": ("transaction_date", "line_item_id"), "line_detail": None,
                "line_status": None, "tracking": None, "shipping_info": None, "returns": None,
                "daily_actuals": None, "pim_models": None, "pim_searches": None,
                "pim_images": None, "item_attributes": None, "vendor_mapping": None}

#: Stored roles whose last step deals rows by the key of their buckets.
DEALT = ("line_rows",)

#: Stored roles whose columns are computed again when they are read: rows to store, and the columns over them.
#: The columns repeat each other (a price as decimal and as scaled integer, a number as several texts), so the rows
#: are dealt and written in about half the bytes.
NARROW = {"txn": (_txn_rows, _txn_columns), "line_items": (_line_item_rows, _line_item_columns)}

#: The rows below further roles.
ROWS = {"research": _research_rows, "research_pricing": research_pricing_rows}

ROLE_BUILDERS = {
    "txn": _txn,
    "line_rows": _line_rows,
    "line_detail": _line_detail,
    "line_status": _line_status,
    "tracking": _tracking,
    "shipping_info": _shipping_info,
    "ship_methods": _ship_methods,
    "returns": _returns,
    "research": _research,
    "vendors": _vendors,
    "customers": _customers,
    "organization": _organization,
    "requestors": _requestors,
    "part_numbers": _part_numbers,
    "vendor_mapping": _vendor_mapping,
    "auto_order": _auto_order,
    "contacts": _contacts,
    "items": _items,
    "item_prices": _item_prices,
    "formulary": _formulary,
    "pricing_rules": _pricing_rules,
    "calendar": _calendar,
    "daily_actuals": _daily_actuals,
    "line_items": _line_items,
    "confirmations": _confirmations,
    "invoices": _invoices,
    "received_parts": _received_parts,
    "admin_actions": _admin_actions,
    "condition_codes": _condition_codes,
    "warranty_codes": _warranty_codes,
    "urgency_codes": _urgency_codes,
    "budget_supplement": _budget_supplement,
    "oems": _oems,
    "product_structure": _product_structure,
    "oem_structure": _oem_structure,
    "oem_structure_products": _oem_structure_products,
    "pim_images": _pim_images,
    "pim_models": _pim_models,
    "pim_searches": _pim_searches,
    "item_logistics": _item_logistics,
    "item_attributes": _item_attributes,
    "item_references": _references,
    "modalities": _modalities,
    "product_classes": _product_classes,
    "product_categories": _product_categories,
    **LOAD_ROLES,
}
