"""Orders as plans: shipping a part is a step, returning it another.

A plan is an order, its problem the customer. Lines are taken in a fixed total
order; a line ships its part (sometimes with a faulty operator or swapped
arguments) and, when returned, sends it back.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators.bounded import hot_keys, key_counts, long_groups, lookup, number_rows, unpruned
from planloom.operators.stats import MEASURES, plan_sizes
from planloom.plans.corpus import Corpus, union

LINE_ORDER = [
    "l_linenumber",
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]
LINE_BLOCK = ["l_linenumber", "l_shipdate"]

# Plans that are sent to all tasks: 8 MB of keys.
SENT_PLANS = 1_000_000

# Rows of lines and orders that a task of ordered work gets, and tasks for small tables. A line becomes up to ten events
# that are sorted several times over, so these are far fewer rows than the same bytes would be elsewhere.
TASK_ROWS = 100_000
LEAST_TASKS = 8

# The thresholds that plant each kind of error.
STOCKED_QUANTITY = 45
SWAPPED_DISCOUNT = 0.10
RECALLED_TAX = 0.08
UNLISTED_SIZE = 50


def named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def returned() -> Column:
    return F.col("l_returnflag") == "R"


def is_line() -> Column:
    """Whether a row is a line; an order without lines is one row without a part."""
    return F.col("l_linenumber").isNotNull()


def n_steps() -> Column:
    return F.when(~is_line(), 0).when(returned(), 2).otherwise(1)


def problem(custkey: str = "o_custkey") -> Column:
    return named("cust", custkey)


def plan_name(custkey: str = "o_custkey", orderkey: str = "plan_id") -> Column:
    return F.concat(
        F.lit("xml-GEN-cust"), F.col(custkey), F.lit("_"), F.col(orderkey), F.lit(".SOL")
    )


def actions_seen(plan_id: str = "plan_id") -> Column:
    return F.pmod(F.col(plan_id), F.lit(6)).cast("int")


def objects() -> Column:
    """The part, supplier and customer of a line with their types, as far as the tables list them."""
    things = (("part", "part", "l_partkey"), ("supp", "supplier", "l_suppkey"), ("cust", "customer", "o_custkey"))
    listed = [F.when(F.col(f"has_{key}"), F.struct(named(prefix, key).alias("name"), F.lit(kind).alias("type"))) for prefix, kind, key in things]
    return F.array_compact(F.array(*listed)).alias("objects")


def as_chunks(frame: DataFrame, *keep: str) -> DataFrame:
    """Lines (numbered or not) as chunks of one or two steps, orders without lines as empty chunks.

    ``objects`` may be kept of lines that :meth:`OrderPlans.with_objects` flagged.
    """

    def fact(*parts: Column) -> Column:
        return F.concat(F.lit("at"), *parts)

    def step(op: Column, *args: Column) -> Column:
        return F.struct(op.alias("op"), F.array(*args).alias("args"))

    part, supp, cust = named("part", "l_partkey"), named("supp", "l_suppkey"), problem()
    recalled = (F.col("l_linestatus") == "O") & (F.col("l_tax") == RECALLED_TAX)
    swapped = F.col("l_discount") == SWAPPED_DISCOUNT
    ship = step(
        F.when(recalled, F.lit("RECALL-PART")).otherwise(F.lit("SHIP-PART")),
        part,
        F.when(swapped, cust).otherwise(supp),
        F.when(swapped, supp).otherwise(cust),
    )
    back = step(F.lit("RETURN-PART"), part, cust, supp)
    none = F.array().cast("array<string>")
    no_step = F.array().cast("array<struct<op:string,args:array<string>>>")
    stocked = F.col("l_quantity") <= STOCKED_QUANTITY
    seq = F.col("seq") if "seq" in frame.columns else F.lit(None).cast("long")
    return frame.select(
        "plan_id",
        seq.alias("seq"),
        F.when(stocked, F.array(fact(part, supp))).otherwise(none).alias("initial"),
        F.when(is_line(), F.array(fact(part, cust))).otherwise(none).alias("goals"),
        F.when(~is_line(), no_step).when(returned(), F.array(ship, back)).otherwise(F.array(ship)).alias("steps"),
        *(objects() if c == "objects" else c for c in keep),
    )


class OrderPlans:
    """The plan corpus of one set of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")

        self.table = table
        self.carried: list[str] = []
        self.line_flags: list[str] = []
        self.lineitem = table("lineitem").withColumnRenamed("l_orderkey", "plan_id")
        self.orders = table("orders").withColumnRenamed("o_orderkey", "plan_id")

    def only(self, plans: DataFrame) -> OrderPlans:
        """The same tables with some plans only. Distinct ``plans`` that are counted to be few are sent to the lines."""
        few = plans.limit(SENT_PLANS + 1).count() <= SENT_PLANS
        plans = F.broadcast(plans) if few else plans
        some = copy(self)
        some.lineitem = self.lineitem.join(plans, "plan_id", "left_semi")
        some.orders = self.orders.join(plans, "plan_id", "left_semi")
        return some

    def tasks(self) -> int:
        """How many tasks the rows of lines and orders need."""
        rows = self.lineitem.count() + self.orders.count()
        return max(LEAST_TASKS, -(-rows // TASK_ROWS))

    def dealt(self) -> OrderPlans:
        """The same tables by plan, in as many partitions as their rows need, so that no task grows with the tables.

        Partitions of a given number are not put together again by their bytes.
        """
        tasks = self.tasks()
        some = copy(self)
        some.lineitem = self.lineitem.repartition(tasks, "plan_id")
        some.orders = self.orders.repartition(tasks, "plan_id")
        return some

    def carrying(self, facts: DataFrame) -> OrderPlans:
        """The same tables, with what ``facts`` (one row per ``problem_id``) tell of each order's problem."""
        some = copy(self)
        of_problem = self.orders.withColumn("problem_id", problem())
        some.orders = lookup(of_problem, facts, "problem_id", self.hot_problems()).drop("problem_id")
        some.carried = [*self.carried, *(c for c in facts.columns if c != "problem_id")]
        return some

    def lines(self, empty: bool = False) -> DataFrame:
        """Order lines with their customer and problem, keyed by ``plan_id``.

        With ``empty``, an order without lines has one row without a line.
        """
        line = self.lineitem.select("plan_id", *LINE_ORDER, *self.line_flags)
        customers = self.orders.select("plan_id", "o_custkey", *self.carried)
        return customers.join(line, "plan_id", "left" if empty else "inner").withColumn("problem_id", problem())

    def long_plans(self) -> DataFrame | None:
        return long_groups(self.lineitem, ["plan_id"], n_steps())

    def with_objects(self) -> OrderPlans:
        """The same tables, telling for each line and order which of its objects the tables list.

        Lines meet parts and suppliers, and orders customers, before lines meet their orders, so the lines are
        moved once for the parts and once for the orders.
        """

        def listed(table: DataFrame, key: str, line_key: str) -> DataFrame:
            return table.select(F.col(key).alias(line_key), F.lit(True).alias(f"has_{line_key}"))

        some = copy(self)
        parts = listed(self.table("part").filter(F.col("p_size") != UNLISTED_SIZE), "p_partkey", "l_partkey")
        suppliers = listed(self.table("supplier"), "s_suppkey", "l_suppkey")
        some.lineitem = self.lineitem.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
        some.orders = self.orders.join(listed(self.table("customer"), "c_custkey", "o_custkey"), "o_custkey", "left")
        some.line_flags = [*self.line_flags, "has_l_partkey", "has_l_suppkey"]
        some.carried = [*self.carried, "has_o_custkey"]
        return some

    def corpus(self, *keep: str) -> Corpus:
        long = self.long_plans()
        plans = self.with_objects() if "objects" in keep else self
        ordinary, rest = number_rows(
            plans.dealt().lines(empty=True),
            ["plan_id"],
            LINE_ORDER,
            LINE_BLOCK,
            long,
            n_steps(),
            long_rows=None if long is None else plans.only(long).lines(),
        )
        if rest is None:
            # What needs no order reads the exchange of what does.
            return Corpus(as_chunks(ordinary, *keep), unordered=unpruned(as_chunks(ordinary, *keep)))
        return Corpus(as_chunks(ordinary, *keep), as_chunks(rest, *keep), as_chunks(plans.lines(), *keep))

    def sizes(self) -> DataFrame:
        """Facts, goals and steps per plan, with the customer.

        Lines are counted before the join, where a large order is one row already;
        the customer's name in a fact does not change how many there are.
        """
        nameless = as_chunks(self.lineitem.withColumn("o_custkey", F.lit(None).cast("long")))
        counted = self.orders.select("plan_id", "o_custkey").join(plan_sizes(nameless), "plan_id", "left")
        zero = F.lit(0).cast("long")
        return counted.withColumns({f"n_{m}": F.coalesce(f"n_{m}", zero) for m in MEASURES})

    def steps(self) -> DataFrame:
        """How many steps the orders with lines have: ``plan_id, o_custkey, n_actions``."""
        counted = self.lineitem.groupBy("plan_id").agg(F.sum(n_steps()).alias("n_actions"))
        return self.orders.select("plan_id", "o_custkey").join(counted, "plan_id")

    def unordered(self, *keep: str) -> DataFrame:
        return as_chunks(self.lines(), *keep)

    def objects(self) -> DataFrame:
        """The objects each problem lists, once or more: ``problem_id, name, type``.

        A customer's problem lists the customer, the parts of its orders and their suppliers,
        as far as the tables hold them. Parts of one size are left out.
        """
        part = self.table("part").filter(F.col("p_size") != UNLISTED_SIZE).select(F.lit("part").alias("type"), F.col("p_partkey").alias("key"))
        supplier = self.table("supplier").select(F.lit("supplier").alias("type"), F.col("s_suppkey").alias("key"))
        used = [F.struct(F.lit(kind).alias("type"), F.col(key).alias("key")) for kind, key in (("part", "l_partkey"), ("supplier", "l_suppkey"))]
        # Lines meet their orders once for both; an object of several lines has a row for each.
        of_lines = self.lines().select("problem_id", F.inline(F.array(*used))).join(part.unionByName(supplier), ["type", "key"], "left_semi")
        prefix = F.when(F.col("type") == "part", "part").otherwise("supp")
        customer = problem("c_custkey")
        return union(
            [
                of_lines.select("problem_id", F.concat(prefix, F.col("key").cast("string")).alias("name"), "type"),
                self.table("customer").select(
                    customer.alias("problem_id"), customer.alias("name"), F.lit("customer").alias("type")
                ),
            ]
        )

    def busy_problems(self) -> DataFrame | None:
        """Problems with a large share of the steps."""
        return hot_keys([key_counts(self.steps(), "o_custkey", problem(), "problem_id", "n_actions")])

    def nameless(self) -> bool:
        """Whether any order has no name, for want of a customer or a number; a name is of one order's number only."""
        return not self.orders.filter(plan_name().isNull()).isEmpty()

    def has_hot_parts(self) -> bool:
        """Whether any part has a large share of the lines. All tokens of a line name its part, so else none of them is frequent."""
        return hot_keys([key_counts(self.lineitem, "l_partkey")]) is not None

    def hot_problems(self) -> DataFrame | None:
        """Problems with a large share of the plans."""
        return hot_keys([key_counts(self.orders, "o_custkey", problem(), "problem_id")])
